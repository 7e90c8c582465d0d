"""Mixing sources to target weights by entropy balancing.

Every document may be taken 0 to `most` times. Against a base law under which each of its
`most` possible copies is taken with probability 1 / `most`, the law nearest in relative
entropy that meets the token constraint of its source tilts that base exponentially: the rate of a document of
size z in source s is most / (1 + (most - 1) * exp(-beta_s * z)).
The dual is convex and separate for each source; Newton steps for all sources run at once, each
step being one aggregation over the distinct sizes of every source. A step that would leave the
interval in which the solution is known to lie halves that interval instead.

Rates become whole copies by error diffusion from the longest to the shortest documents of a
source, so that what a source takes misses its target by about half of its shortest document.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import n_words, removed, table, written

#: Rows of one numbering cell of equal source and size.
ROWS_PER_CELL = 4096
#: Newton steps at most (the interval of the solution is halved at least once in two), and the relative error at which they end.
STEPS, NEAR = 120, 1e-9


def targets(sizes: dict[str | None, int], most: int = 3) -> dict[str | None, float]:
    """Words wanted of each source: sources by code point, null last, weigh 1, 2, 3, repeating.

    They share all words; a target stops at `most` times its source's size, and the excess is
    shared anew by weight until none is above.
    """
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: float(1 + i % 3) for i, s in enumerate(names)}
    left, free, out = float(sum(sizes.values())), set(names), dict.fromkeys(names, 0.0)
    while free:
        whole = sum(weight[s] for s in names if s in free)
        over = [s for s in names if s in free and left * weight[s] / whole > most * sizes[s]]
        if not over:
            return out | {s: left * weight[s] / whole for s in free}
        for s in over:
            out[s] = float(most * sizes[s])
            left -= out[s]
            free.discard(s)
    return out


def with_targets(sources: DataFrame, most: int) -> DataFrame:
    """sources (src, n, size) with `target`: as `targets` says, in rounds over the table of sources."""
    order = Window.orderBy(F.col("src") == "~", "src")  # one row for each source
    left = written(sources.withColumns({"weight": (1 + (F.row_number().over(order) - 1) % 3).cast("double"), "target": F.lit(None).cast("double")}), "mix-targets")
    whole = float(left.agg(F.sum("size")).first()[0] or 0)
    while True:
        taken, weight = left.agg(F.coalesce(F.sum("target"), F.lit(0.0)), F.sum(F.when(F.col("target").isNull(), F.col("weight")))).first()
        if not weight:
            return left.drop("weight")
        fair, most_of = (whole - taken) * F.col("weight") / weight, F.col("size") * float(most)
        over = F.col("target").isNull() & (fair > most_of)
        if not left.filter(over).limit(1).count():
            return left.withColumn("target", F.coalesce("target", fair)).drop("weight")
        left = written(left.withColumn("target", F.when(over, most_of).otherwise(F.col("target"))), "mix-targets")


def solved(sizes: DataFrame, sources: DataFrame, most: int) -> DataFrame:
    """sources (src, target, ...) with `beta` and `mean`, by Newton steps over sizes (src, size, n) of at least one word.

    The feature of a document is its size by the source's mean, so that beta has the same scale everywhere.
    """
    mean = sizes.groupBy("src").agg((F.sum(F.col("n") * F.col("size")) / F.sum("n")).alias("mean"))
    full, none = F.col("target") >= most * F.col("size") * (1 - 1e-12), F.col("target") <= 0
    rows = sources.join(mean, "src", "left").withColumn("beta", F.when(full, float("inf")).when(none | F.col("mean").isNull(), float("-inf")).otherwise(0.0))
    now = written(rows.withColumns({"low": F.lit(float("-inf")), "high": F.lit(float("inf")), "open": F.abs("beta") != float("inf")}), "mix-beta")
    for _ in range(STEPS):
        if not now.filter("open").limit(1).count():
            return now.drop("low", "high", "open")
        z = F.col("size") / F.col("mean")
        p = 1 / (1 + (most - 1.0) * F.exp(-F.col("beta") * z))
        asked = now.filter("open").select("src", "mean", "beta")
        sums = sizes.join(asked, "src").groupBy("src").agg(F.sum(F.col("n") * most * p * z).alias("got"), F.sum(F.col("n") * most * p * (1 - p) * z * z).alias("slope"))
        miss = F.col("target") / F.col("mean") - F.col("got")
        low, high = F.when(miss > 0, F.col("beta")).otherwise(F.col("low")), F.when(miss < 0, F.col("beta")).otherwise(F.col("high"))
        step = F.col("beta") + miss / F.greatest("slope", F.lit(1e-300))
        inf = float("inf")
        wide = F.when(F.col("high") == inf, 2 * F.greatest(F.col("low"), F.lit(0.0)) + 1).when(F.col("low") == -inf, 2 * F.least(F.col("high"), F.lit(0.0)) - 1).otherwise((F.col("low") + F.col("high")) / 2)
        within = (step > F.col("low")) & (step < F.col("high")) & (F.abs(step - F.col("beta")) <= 4 * (F.abs("beta") + 1))
        moved = now.join(sums, "src", "left").withColumns({"miss": F.when(F.col("open"), miss), "low": F.when(F.col("open"), low), "high": F.when(F.col("open"), high)})
        near = (F.abs("miss") <= NEAR * F.col("target") / F.col("mean")) | (F.col("high") - F.col("low") <= 1e-15 * F.abs("beta"))
        new = F.when(~F.col("open") | near, F.col("beta")).when(within, step).otherwise(wide)
        new_now = written(moved.select("src", "n", "size", "target", "mean", new.alias("beta"), "low", "high", (F.col("open") & ~near).alias("open")), "mix-beta")
        removed(now)
        now = new_now
    raise ArithmeticError("the mix's rates were not found")


def _diffuse(most: int):
    def rounded(sizes: pd.DataFrame) -> pd.DataFrame:
        """copies of each size of a source: the running error in words goes on to the next shorter size."""
        sizes = sizes.sort_values("size", ascending=False, kind="stable")
        error, out = 0.0, []
        for size, n, rate in zip(sizes["size"].tolist(), sizes["n"].tolist(), sizes["rate"].tolist(), strict=True):
            want = rate * n * size + error
            copies = min(max(math.floor(want / size + 0.5), 0), most * n)
            error = want - copies * size
            out.append(copies)
        return sizes.assign(copies=out)[["src", "size", "n", "copies"]]

    return rounded


def mix(docs: DataFrame, most: int = 3, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", size: Column | None = None) -> DataFrame:
    """Every row of docs with `size`, `source_size`, `target` and `copies` added.

    size: the words of a row, where they are known; else those of its text are counted. Null text and texts without
    a word have size 0 and are taken 0 times. A null source is a
    source of its own, the last. Repeated rows are documents of their own. Equal sizes are told
    apart by a hash of the id, so reruns agree. An empty table gives no rows. Columns of docs that
    have the names of the added ones are replaced.
    """
    words = n_words(F.col(text_col)) if size is None else size
    names = [c for c in docs.columns if c not in ("size", "source_size", "target", "copies")]
    # the row goes along as one column, so that none of its names meets one of ours
    rows = docs.select(F.struct(*names).alias("row"), words.cast("long").alias("_size"), F.coalesce(F.concat(F.lit("="), F.col(source_col)), F.lit("~")).alias("_src"), F.xxhash64(id_col).alias("_order"), F.col(id_col).alias("_id"))
    slim = written(rows.select("_src", "_size", "_order"), "mix-sizes")
    every = written(slim.groupBy(F.col("_src").alias("src"), F.col("_size").alias("size")).agg(F.count(F.lit(1)).alias("n")), "mix-counts")
    sizes = every.filter("size > 0")
    sources = every.groupBy("src").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("size")).alias("size"))
    by_source = solved(sizes, with_targets(sources, most), most)
    rate = most / (1 + (most - 1.0) * F.exp(-F.col("beta") * F.col("size") / F.coalesce("mean", F.lit(1.0))))
    rated = sizes.join(by_source.select("src", "beta", "mean"), "src").select("src", "size", "n", rate.alias("rate"))
    whole = rated.groupBy("src").applyInPandas(_diffuse(most), "src string, size long, n long, copies long")  # a source has no more sizes than its longest text has words
    # equal sizes of a source are spread over cells by a hash, so that no cell grows with the input; a cell gets the copies that
    # bring those of all cells up to it to its share
    spread = every.select(F.col("src").alias("_src"), F.col("size").alias("_size"), F.ceil(F.col("n") / ROWS_PER_CELL).cast("int").alias("_spread"))
    cell = F.pmod("_order", F.col("_spread")).cast("int").alias("_cell")
    counts = slim.filter("_size > 0").join(spread, ["_src", "_size"]).groupBy("_src", "_size", cell).agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.partitionBy("_src", "_size").orderBy("_cell"))
    shared = counts.withColumn("upto", upto).alias("c").join(whole.alias("w"), (F.col("c._src") == F.col("w.src")) & (F.col("c._size") == F.col("w.size")))
    share = lambda n: F.floor(F.col("w.copies") * n / F.col("w.n"))
    copies = written(shared.select("c._src", "c._size", "c._cell", "c.n", (share(F.col("c.upto")) - share(F.col("c.upto") - F.col("c.n"))).alias("copies")), "mix-copies")
    dealt = rows.join(spread, ["_src", "_size"]).select("*", cell).drop("_spread")
    ranked = dealt.withColumn("_rank", F.row_number().over(Window.partitionBy("_src", "_size", "_cell").orderBy("_order", "_id")))
    mine = copies.withColumnsRenamed({"n": "_n", "copies": "_copies"})
    taken = F.floor(F.col("_copies") / F.col("_n")) + F.when(F.col("_rank") <= F.col("_copies") % F.col("_n"), 1).otherwise(0)
    out = ranked.join(mine, ["_src", "_size", "_cell"], "left").join(by_source.select(F.col("src").alias("_src"), F.col("size").alias("_whole"), F.col("target").alias("_target")), "_src")
    return out.select("row.*", F.col("_size").alias("size"), F.col("_whole").alias("source_size"), F.col("_target").alias("target"), F.coalesce(taken, F.lit(0)).cast("int").alias("copies"))


def copied(mixed: DataFrame) -> DataFrame:
    """The mix itself: each row as often as it's taken, without the added columns."""
    kept = [c for c in mixed.columns if c not in ("size", "source_size", "target", "copies")]
    return mixed.filter("copies > 0").select(*kept, F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*kept)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    sized = written(docs.select("doc_id", "source", n_words(F.col("text")).alias("words")), "mix-documents")  # the texts are read once
    return mix(sized, size=F.col("words")).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"))
