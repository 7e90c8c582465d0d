"""Tables that are kept beside the input: made once from it, read by many queries, made anew when the input changes.

They lie in the folder that spark.checkpoint.dir names, under a key of the input's files (path, length, time of change)
and of the table's version, so a changed input never meets an old table. A table is written whole beside its place and
then moved there; of two writers one moves, the other drops its own.
"""

from __future__ import annotations

import atexit
import hashlib
import tempfile
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession


def hadoop(spark: SparkSession, path: str):
    """The file system of a path, and the path."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    fs, target = hadoop(spark, path)
    return fs.exists(target)


def deleted(spark: SparkSession, path: str) -> bool:
    fs, target = hadoop(spark, path)
    return fs.delete(target, True)


def moved(spark: SparkSession, path: str, to: str) -> bool:
    """Whether the folder is now at `to`; it isn't where something is there already."""
    fs, target = hadoop(spark, path)
    there = hadoop(spark, to)[1]
    return not fs.exists(there) and fs.rename(target, there)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one on a single machine that names none."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="ledgerlight-"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


_WORK: list[tuple[SparkSession, str]] = []


@atexit.register
def _clear() -> None:
    for spark, path in _WORK:
        try:
            deleted(spark, path)
        except Exception:  # the session may be gone at exit
            pass
    _WORK.clear()


def work_folder(spark: SparkSession, what: str) -> str:
    """A folder of one's own in the shared folder. It goes when the process ends."""
    path = f"{shared_folder(spark)}/work-{spark.sparkContext.applicationId}-{what}-{uuid.uuid4().hex[:12]}"
    _WORK.append((spark, path))
    return path


def written(rows: DataFrame, what: str) -> DataFrame:
    """rows from a table in such a folder, so that all that follows reads what was made once."""
    path = work_folder(rows.sparkSession, what)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def fingerprint(spark: SparkSession, paths: Sequence[str], version: str) -> str:
    """A key of the files under the paths; their listing is the driver's, as for every read."""
    parts = [version]
    for path in paths:
        fs, target = hadoop(spark, path)
        files = fs.listFiles(target, True)
        found = []
        while files.hasNext():
            f = files.next()
            found.append(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}")
        parts += sorted(found)
    return hashlib.sha256("\n".join(parts).encode()).hexdigest()[:24]


def kept_folder(spark: SparkSession, name: str, sources: Sequence[str], version: str, write: Callable[[str], None]) -> str:
    """The folder of what `write` (which gets a folder to write into) makes of the sources."""
    path = f"{shared_folder(spark)}/kept-{name}-{fingerprint(spark, sources, version)}"
    if not exists(spark, path):
        beside = f"{path}-{uuid.uuid4().hex[:8]}"
        write(beside)
        if not moved(spark, beside, path):
            deleted(spark, beside)
    return path


def kept(spark: SparkSession, name: str, sources: Sequence[str], version: str, make: Callable[[], DataFrame], by: str, order: Sequence[str]) -> DataFrame:
    """The kept table of this name, with a folder for each value of `by`; each task's rows lie there in `order`, as one file.

    Rows are written where they are made: putting all of them in one order would shuffle them once and sample them before.
    """
    made = make()

    def write(to: str) -> None:
        made.sortWithinPartitions(by, *order).write.partitionBy(by).parquet(to)

    path = kept_folder(spark, name, sources, version, write)
    return spark.read.schema(made.schema).parquet(path).select(*made.columns)
