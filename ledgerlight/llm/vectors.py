"""What the two vector searches share."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def finite(vec: Column) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vec.isNotNull() & (F.size(vec) > 0) & ~F.coalesce(bad, F.lit(True))


def distinct_vectors(rows: DataFrame, keep: int) -> DataFrame:
    """rows (id, vec) to one row for each distinct vector: rep (its least id), ids (its `keep` least ids), vec.

    No more than `keep` rows with one vector can be among the `keep` best of any query when ties
    go to the smaller id. The rank's limit is applied before the shuffle too, so a vector that a
    third of all rows share costs each task `keep` rows.
    """
    order = Window.partitionBy("vec").orderBy("id")
    least = rows.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= keep)
    return least.groupBy("vec").agg(F.array_sort(F.collect_list("id")).alias("ids")).select(F.element_at("ids", 1).alias("rep"), "ids", "vec")


def matrix(vectors: pd.Series, width: int) -> np.ndarray:
    """Rows of doubles; shorter vectors are continued with zeros."""
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def bounded_sample(reps: DataFrame, most: int) -> pd.DataFrame:
    """At most `most` of the vectors, the same ones in every run: those with the least hash of their id."""
    return reps.orderBy(F.xxhash64("rep"), "rep").limit(most).select("rep", "vec").toPandas()


def best_ids(found: DataFrame, k: int, score: str = "score") -> DataFrame:
    """found (query_id, rep, ids, score) to the k best ids of each query, without the query itself."""
    each = (
        found.dropDuplicates(["query_id", "rep"])
        .select("query_id", F.explode("ids").alias("vec_id"), score)
        .filter("vec_id <> query_id")
    )
    order = Window.partitionBy("query_id").orderBy(F.desc(score), "vec_id")
    return each.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", score)
