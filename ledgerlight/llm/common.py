"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
import weakref

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_WRITTEN: dict[str, weakref.ref] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; if its files are one task's worth at most (by Spark's own estimate), dealt to all cores, since a row group can't be split. Larger ones are read as they lie."""
    rows = table(spark, sf_dir, name)
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return rows.repartition(spark.sparkContext.defaultParallelism) if size < spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes() else rows


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the cluster names it.

    Where spark.checkpoint.dir is unset (tests on one machine), a temporary folder
    becomes the session's own setting.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        folder = spark.sparkContext.getCheckpointDir()
        if not folder:
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="ledgerlight-"))
            folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def remove_written() -> None:
    """Remove this process's intermediate tables."""
    for path, ref in list(_WRITTEN.items()):
        spark = ref()
        try:
            if spark is not None and spark.sparkContext._jsc is not None:
                _remove(spark, path)
        except Exception:  # the session may be gone at exit
            pass
        _WRITTEN.pop(path, None)


def written(df: DataFrame, what: str) -> DataFrame:
    """Write df to the shared folder and read it back.

    This cuts the lineage, fixes the result for all later readers, and survives lost
    executors. The files go with `removed`, or when the process ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}-{what}-{uuid.uuid4().hex[:12]}"
    _WRITTEN[path] = weakref.ref(spark)
    schema = df.schema
    df.write.parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out.written_to = path
    return out


def removed(*tables: DataFrame) -> None:
    """Remove written tables that no later plan reads."""
    for df in tables:
        if _WRITTEN.pop(df.written_to, None) is not None:
            _remove(df.sparkSession, df.written_to)


def fresh(docs: DataFrame, *names: str) -> list[str]:
    """Names for columns of our own that docs has none of: underscores are added until that's so."""
    taken, out = {c.lower() for c in docs.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def shielded(docs: DataFrame, *added: str) -> tuple[DataFrame, list[Column]]:
    """docs with other names for the columns that are named like `added` ones, and the columns that give them back theirs."""
    clash = [c for c in docs.columns if c.lower() in {a.lower() for a in added}]
    names = dict(zip(clash, fresh(docs, *[f"{c}_" for c in clash]), strict=True))
    return docs.withColumnsRenamed(names), [F.col(names.get(c, c)).alias(c) for c in docs.columns]


def give_back() -> None:
    """Return memory that this Python worker holds but doesn't use to the system: it lives on through the stages that follow, beside the next worker's."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def text_bytes(text: Column) -> Column:
    """UTF-8 bytes of a text; null has none."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def text_key(text: Column) -> Column:
    """A 64-bit key of a text, with a value for null too."""
    return F.coalesce(F.xxhash64(text), F.lit(0))


def n_words(text: Column) -> Column:
    """Number of runs of characters other than white space (U+0020, U+0009 to U+000D)."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def parts_for(rows: int, per_part: int, spark: SparkSession) -> int:
    """Partitions so that each has about per_part rows, and no fewer than the cluster's setting."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // per_part))
