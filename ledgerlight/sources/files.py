"""Files as they lie in a folder: read whole in batches and streams, decoded by one rule, kept under keys that can't leave their root."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .kept import hadoop

FILES = "path string, modificationTime timestamp, length long, content binary"
#: What a file of these endings is said to be where nobody has said it.
MIME = {"txt": "text/plain", "csv": "text/csv", "pdf": "application/pdf", "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "tif": "image/tiff", "tiff": "image/tiff", "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet"}
TEXT_LIKE = ("text/plain", "text/csv")
#: Parts of a key: letters, digits and a few marks, none of only dots.
KEY = re.compile(r"[A-Za-z0-9_][A-Za-z0-9._=-]*(/[A-Za-z0-9_][A-Za-z0-9._=-]*)*")


def decoded(content: Column) -> Column:
    """UTF-8 bytes as a text; each run of bytes that is none becomes U+FFFD. A byte order mark stays for the text's own rules."""
    return F.make_valid_utf8(content.cast("string"))


def _with_kinds(files: DataFrame) -> DataFrame:
    ending = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    mime = F.element_at(F.create_map(*[F.lit(x) for kv in MIME.items() for x in kv]), ending)
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), mime.alias("mime"), F.col("length").alias("size_bytes"), "content")


def files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """path, name, mime, size_bytes, content of all files under the folder that hold a byte. Columns that nobody selects (content) aren't read."""
    return _with_kinds(spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder))


def files_stream(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """The same of files as they land."""
    return _with_kinds(spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder))


def texts(accepted: DataFrame) -> DataFrame:
    """Accepted files with their text; null for those of kinds that hold none that can be read here (images, scans, PDF)."""
    return accepted.withColumn("text", F.when(F.col("mime").isin(*TEXT_LIKE), decoded(F.col("content")))).drop("content")


class Storage:
    """Objects under a root of any Hadoop file system. A key that is there is never written again."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, key: str) -> str:
        if not KEY.fullmatch(key):
            raise ValueError("no such key")
        return f"{self.root}/{key}"

    def put(self, key: str, content: bytes) -> int:
        """Store bytes under a new key; FileExistsError where it's taken."""
        fs, target = hadoop(self.spark, self.path(key))
        if fs.exists(target):
            raise FileExistsError(key)
        out = fs.create(target, False)
        try:
            out.write(bytearray(content))
        finally:
            out.close()
        return len(content)

    def exists(self, key: str) -> bool:
        try:
            fs, target = hadoop(self.spark, self.path(key))
        except ValueError:
            return False
        return fs.exists(target)

    def delete(self, key: str) -> None:
        """What is gone already is gone."""
        fs, target = hadoop(self.spark, self.path(key))
        fs.delete(target, False)

    def read(self, key: str) -> DataFrame:
        return files(self.spark, self.path(key))
