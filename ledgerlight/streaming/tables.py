"""Tables that streams write: replacing rows of some sources, and appending once, whatever dies and runs again."""

from __future__ import annotations

import logging
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.kept import exists, hadoop

BUCKETS = 64
AUDIT = "id long, at timestamp_ntz, action string, user_id long, target_type string, target_id string, tenant long, metadata map<string,string>"

log = logging.getLogger(__name__)


def stored(spark: SparkSession, table: str, schema) -> DataFrame:
    """A table's rows, or none where it isn't there yet. A move that a killed run left undone is finished first."""
    swap(spark, table)
    return spark.read.schema(schema).parquet(table) if exists(spark, table) else spark.createDataFrame([], schema)


def swap(spark: SparkSession, table: str) -> None:
    """Move the partitions of a complete staging folder into the table. Half done, it is finished by the next call."""
    staging = f"{table}_staging"
    fs, at = hadoop(spark, staging)
    if not fs.exists(at):
        return
    if fs.exists(hadoop(spark, f"{staging}/_SUCCESS")[1]):
        fs.mkdirs(hadoop(spark, table)[1])
        for entry in fs.listStatus(at):
            name = entry.getPath().getName()
            if "=" in name:
                target = hadoop(spark, f"{table}/{name}")[1]
                fs.delete(target, True)
                fs.rename(entry.getPath(), target)
    fs.delete(at, True)


def replace_in(table: str, new: DataFrame, key: str | Sequence[str], sources: DataFrame, by: str = "bucket", of: Column | None = None) -> None:
    """Replace all rows of the given sources in a table that has a folder for each value of `by`.

    of: that value from the sources' own columns; without it, a hash of the key in BUCKETS. Only the folders of those sources are
    written anew: first whole beside the table, then moved into it. A run that dies before the move leaves the table as it was;
    one that dies during it is finished by the next.
    """
    spark = new.sparkSession
    keys = [key] if isinstance(key, str) else list(key)
    swap(spark, table)
    if of is None:
        of = F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int")
        new = new.withColumn(by, of)
    touched = [r[0] for r in sources.select(of.alias(by)).distinct().collect()]  # BUCKETS, or the months of a batch
    if exists(spark, table):
        old = spark.read.schema(new.schema).parquet(table).select(*new.columns).filter(F.col(by).isin(touched)).join(sources.select(*keys).distinct(), keys, "left_anti")
        new = new.unionByName(old.select(*new.columns))
    new.write.mode("overwrite").partitionBy(by).parquet(f"{table}_staging")
    fs, at = hadoop(spark, f"{table}_staging")
    filled = {entry.getPath().getName() for entry in fs.listStatus(at)}
    for empty in touched:  # a folder of which nothing is left
        if f"{by}={empty}" not in filled:
            fs.delete(hadoop(spark, f"{table}/{by}={empty}")[1], True)
    swap(spark, table)


def append_once(table: str, rows: DataFrame, stream: str, batch: int) -> bool:
    """Write rows as what this batch of this stream adds. The same batch again writes the same folder again, so it adds nothing.

    Never fails its caller: what can't be written is logged, and the answer is False.
    """
    try:
        rows.write.mode("overwrite").parquet(f"{table}/stream={stream}/batch={batch}")
        return True
    except Exception as error:
        log.error("%s: batch %d of %s was not appended: %s", table, batch, stream, type(error).__name__)
        return False


def audit_rows(rows: DataFrame, action: Column, target_type: str, target: Column, user: Column, tenant: Column, metadata: dict[str, Column], at: Column) -> DataFrame:
    """Entries of the audit trail: ids and counts alone, never a text. Entries without a user or a tenant are taken too."""
    pairs = [x for k, v in metadata.items() for x in (F.lit(k), v.cast("string"))]
    return rows.select(
        F.xxhash64(action, F.lit(target_type), target, at).alias("id"), at.cast("timestamp_ntz").alias("at"), action.alias("action"), user.cast("long").alias("user_id"), F.lit(target_type).alias("target_type"),
        target.cast("string").alias("target_id"), tenant.cast("long").alias("tenant"), F.create_map(*pairs).alias("metadata"),
    )
