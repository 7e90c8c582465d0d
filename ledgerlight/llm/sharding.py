"""Sharding by best-fit-decreasing bin packing of indivisible groups.

Groups (here: equal texts) are packed in two levels. Tasks pack the groups of one hash
partition into bundles of a small fixed capacity, largest group first, each into the open
bundle with the tightest remaining capacity that still holds it, found in a balanced search
tree. The bundles, about as many as a parameter says and at least one for each task, are then packed
by the same rule into shards of the smallest capacity for which the wanted number of shards
is enough (bisection over the capacity).

A group larger than a shard can't stay whole when sizes have to be near equal: it's split by a
hash of the row id into as many parts as bring each under a bundle's capacity.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import parts_for, table, text_bytes, text_key, written

#: Bundles wanted over all tasks; the driver sees at most twice these plus two for each task.
BUNDLES = 4096
#: Groups that one packing task sorts.
GROUPS_PER_TASK = 200_000
#: Rows of one numbering cell.
ROWS_PER_CELL = 20_000


class RemainingTree:
    """Open bins by remaining capacity: a treap over (remaining, bin)."""

    def __init__(self) -> None:
        self.root: list | None = None  # [key, priority, left, right]
        self._seed = 0x9E3779B97F4A7C15

    def _priority(self) -> int:
        self._seed = (self._seed * 6364136223846793005 + 1442695040888963407) & 0xFFFFFFFFFFFFFFFF
        return self._seed >> 20

    @staticmethod
    def _split(node, key):
        """Nodes below key, and the others."""
        if node is None:
            return None, None
        if node[0] < key:
            node[3], high = RemainingTree._split(node[3], key)
            return node, high
        low, node[2] = RemainingTree._split(node[2], key)
        return low, node

    @staticmethod
    def _join(low, high):
        if low is None or high is None:
            return low or high
        if low[1] > high[1]:
            low[3] = RemainingTree._join(low[3], high)
            return low
        high[2] = RemainingTree._join(low, high[2])
        return high

    def add(self, remaining: int, number: int) -> None:
        low, high = self._split(self.root, (remaining, number))
        node = [(remaining, number), self._priority(), None, None]
        self.root = self._join(self._join(low, node), high)

    def take_tightest(self, size: int) -> tuple[int, int] | None:
        """Remove and return the bin with the least remaining capacity of at least size."""
        found, node = None, self.root
        while node is not None:
            if node[0] >= (size, -1):
                found, node = node[0], node[2]
            else:
                node = node[3]
        if found is not None:
            low, rest = self._split(self.root, found)
            _, high = self._split(rest, (found[0], found[1] + 1))
            self.root = self._join(low, high)
        return found


def best_fit(sizes: list[int], capacity: int, most: int | None = None) -> list[int] | None:
    """Bin of each size; the sizes come in decreasing order. None if more than `most` bins are needed.

    A size over the capacity gets a bin of its own.
    """
    tree, bins, out = RemainingTree(), 0, []
    for size in sizes:
        found = tree.take_tightest(size)
        if found is None:
            if bins == most:
                return None
            found, bins = (max(capacity, size), bins), bins + 1
        out.append(found[1])
        if found[0] > size:
            tree.add(found[0] - size, found[1])
    return out


def _least_capacity(sizes: list[int], shards: int) -> list[int]:
    """Bins 0 to shards - 1 by best fit decreasing at the least capacity that suffices."""
    low = max(max(sizes), -(-sum(sizes) // shards))
    high, got = low, best_fit(sizes, low, shards)
    while got is None:
        low, high = high, high + max(1, high // 64)
        got = best_fit(sizes, high, shards)
    for _ in range(12):
        middle = (low + high) // 2
        if middle in (low, high):
            break
        if (tried := best_fit(sizes, middle, shards)) is None:
            low = middle
        else:
            high, got = middle, tried
    return got


def pack_groups(groups: DataFrame, capacity: int, tasks: int) -> DataFrame:
    """groups (key, part, size) to (key, part, size, bundle), packed within each task.

    `bundle` is unique over all tasks. The order within a task is by size, then key, so a task
    that runs again gives the same bundles.
    """

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = [b for b in batches if len(b)]
        if not rows:
            return
        rows = pd.concat(rows).sort_values(["size", "key", "part"], ascending=[False, True, True], kind="stable")
        local = best_fit(rows["size"].tolist(), capacity)
        task = int(rows["task"].iloc[0])
        for at in range(0, len(rows), 50_000):
            piece = rows.iloc[at : at + 50_000]
            yield piece.drop(columns="task").assign(bundle=[(task << 32) + b for b in local[at : at + 50_000]])

    return (
        groups.repartition(tasks, "key", "part")
        .withColumn("task", F.spark_partition_id().cast("long"))
        .mapInPandas(pack, "key long, part int, size long, bundle long")
    )


def shard_documents(docs: DataFrame, shards: int = 16, bundles: int = BUNDLES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row of docs with `size`, `shard` and `slot` added; extra columns are dropped.

    Returns id, size, text_crc32, law, shard, slot, grown_shard. Sizes of the shards are near
    equal (law `bytes`) and equal texts share a shard unless they alone exceed one.

    Null text: 1 byte of size, no bytes for the checksum (0); all null texts are one group. Empty
    text: the same size, a group of its own kind. Repeated rows are separate rows of one group.
    Ties go by the group's key. An empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (text_bytes(F.col(text_col)) + 1).alias("size"),
        F.coalesce(F.crc32(F.col(text_col).cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        text_key(F.col(text_col)).alias("key"),
    )
    rows = written(rows, "shard-rows")
    whole = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))
    total, n_rows, n_groups = whole.agg(F.sum("bytes"), F.sum("n"), F.count(F.lit(1))).first()
    schema = "doc_id long, size long, text_crc32 long, law string, shard int, slot long, grown_shard int"
    if not n_rows:
        return spark.createDataFrame([], schema)
    bundle_size = max(1, total // bundles)
    # fewer than `shards` groups can be larger than a shard
    heavy = whole.filter(F.col("bytes") * shards > total).collect() if shards > 1 else []
    part = F.lit(0)
    for g in heavy:
        part = F.when(F.col("key") == g["key"], F.pmod(F.xxhash64("doc_id"), F.lit(-(-g["bytes"] // bundle_size)))).otherwise(part)
    rows = rows.withColumn("part", part.cast("int"))
    groups = rows.groupBy("key", "part").agg(F.sum("size").alias("size"))
    packed = written(pack_groups(groups, bundle_size, parts_for(n_groups, GROUPS_PER_TASK, spark)), "shard-bundles")
    sums = packed.groupBy("bundle").agg(F.sum("size").alias("size")).orderBy(F.desc("size"), "bundle").collect()
    to_shard = spark.createDataFrame(
        list(zip([r["bundle"] for r in sums], _least_capacity([r["size"] for r in sums], shards), strict=True)), "bundle long, shard int"
    )
    placed = packed.join(F.broadcast(to_shard) if len(sums) <= 1_000_000 else to_shard, "bundle").select("key", "part", "shard")
    return numbered(rows.join(placed, ["key", "part"]), n_rows).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def numbered(rows: DataFrame, n_rows: int) -> DataFrame:
    """A gapless `slot` from 0 within each shard, without one task for a shard.

    Rows are dealt to cells by a hash of their id. A cell's slots begin where the cells before
    it in its shard end.
    """
    cells = max(64, -(-n_rows // ROWS_PER_CELL))
    rows = rows.withColumn("cell", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(cells)).cast("int"))
    counts = rows.groupBy("shard", "cell").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))).select("shard", "cell", "start")
    within = Window.partitionBy("shard", "cell").orderBy("doc_id", "text_crc32", "size")
    return (
        rows.withColumn("at", F.row_number().over(within) - 1)
        .join(starts, ["shard", "cell"])
        .withColumn("slot", (F.col("start") + F.col("at")).cast("long"))
    )


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))
