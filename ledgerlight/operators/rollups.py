"""Rollups that merge: sums, and exact distinct counts as bitmaps.

The distinct count of a quarter isn't the sum of its months'. A month's set of ids is kept as bitmaps instead (one for each range of
32,768 ids that occurs), whose union has the quarter's count, exactly and without the rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Changes with what a rollup holds.
VERSION = "rollup-1"


def rolled(rows: DataFrame, by: dict[str, Column], sums: dict[str, Column], ids: Column) -> tuple[DataFrame, DataFrame]:
    """Sums of rows by keys, and the sets of ids (null: none) by keys and range."""
    keyed = rows.select(*[v.alias(k) for k, v in by.items()], *[v.alias(f"_{k}") for k, v in sums.items()], ids.alias("_id"))
    sets = keyed.filter(F.col("_id").isNotNull()).groupBy(*by, F.bitmap_bucket_number("_id").alias("range")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("_id")).alias("bits"))
    return keyed.groupBy(*by).agg(*[F.sum(f"_{k}").alias(k) for k in sums]), sets


def merged(sums: DataFrame, sets: DataFrame, by: dict[str, Column], names: Sequence[str], distinct: str) -> DataFrame:
    """A rollup by coarser keys (made of its own): sums of sums, and the sizes of the unions of sets as `distinct`."""
    whole = sums.groupBy(*[v.alias(k) for k, v in by.items()]).agg(*[F.sum(n).alias(n) for n in names])
    union = sets.groupBy(*[v.alias(k) for k, v in by.items()], "range").agg(F.bitmap_or_agg("bits").alias("bits"))
    if not by:
        return whole.crossJoin(union.agg(F.coalesce(F.sum(F.bitmap_count("bits")), F.lit(0)).alias(distinct)))  # a row each
    sizes = union.groupBy(*by).agg(F.sum(F.bitmap_count("bits")).alias(distinct))
    same = [F.col(f"w.{k}").eqNullSafe(F.col(f"s.{k}")) for k in by]
    condition = same[0]
    for more in same[1:]:
        condition &= more
    return whole.alias("w").join(sizes.alias("s"), condition, "left").select("w.*", F.coalesce(f"s.{distinct}", F.lit(0)).alias(distinct))
