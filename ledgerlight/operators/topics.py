"""Terms: the fact table of term counts, cloud, trend, comparison and clusters."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import metrics
from ..functions.calendar import month_key, quarter_key
from ..functions.text import term_counts

MOST_TERMS, SAMPLE = 300, 25
CLUSTER_TERMS, MOST_CLUSTERS, CLUSTER_SIZE, NEARNESS = 60, 25, 12, 0.35
#: Changes with the way terms are made or counted.
VERSION = "terms-2"
SOURCE = ["source_type", "source_id", "tenant", "source_created_at"]


def word_frequencies(sources: DataFrame, most: int = MOST_TERMS) -> DataFrame:
    """source_type, source_id, tenant, source_created_at, text to the `most` first terms of each source by count, then term.

    A source's period is that of its own creation, whenever it is indexed. A source in one row is counted and cut where its text is; only the terms of sources in
    several rows (by their ids alone) are shuffled and added up.
    """
    ids = ["source_type", "source_id"]
    repeated = sources.groupBy(*ids).agg(F.count(F.lit(1)).alias("_rows")).filter("_rows > 1").select(*[F.col(x).alias(f"_{x}") for x in ids])
    same = F.expr("source_type <=> _source_type AND source_id <=> _source_id")
    period = {"period_month": month_key(F.col("source_created_at")), "period_quarter": quarter_key(F.col("source_created_at"))}
    # periods are those of a source, so they are made once for it, not for each of its terms
    counted = lambda part, cut: part.withColumns(period).select(*SOURCE, *period, F.inline(term_counts(F.col("text"), cut)))
    several = counted(sources.join(repeated, same, "left_semi"), None).groupBy(*SOURCE, *period, "term").agg(F.sum("n").alias("n"))
    order = Window.partitionBy(*ids).orderBy(F.desc("n"), "term")
    several = several.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= most).drop("_rank")
    return counted(sources.join(repeated, same, "left_anti"), most).unionByName(several).select(*SOURCE, "term", "n", *period)


def most_frequent(terms: DataFrame, min_sources: int, limit: int) -> DataFrame:
    """term and total of the first `limit` terms by total, then term, of those that have enough sources.

    Totals add up before the shuffle. So do the least and the largest source, which differ where there are two; more than two sources have to be told apart.
    """
    whole = terms.groupBy("term").agg(F.sum("n").alias("total"), F.min("source_id").alias("_least"), F.max("source_id").alias("_largest"))
    if min_sources == 2:
        whole = whole.filter("_least <> _largest")
    elif min_sources > 2:
        enough = terms.select("term", "source_id").distinct().groupBy("term").agg(F.count(F.lit(1)).alias("_sources")).filter(F.col("_sources") >= min_sources)
        whole = whole.join(enough, "term", "left_semi")
    return whole.orderBy(F.desc("total"), "term").limit(limit).select("term", "total")


def counted(terms: DataFrame, top: DataFrame, *by: str) -> DataFrame:
    """frequency and source_count of the few terms of `top`, whose rows alone go on."""
    by_source = terms.join(F.broadcast(top), "term").groupBy("term", *by, "total", "source_id").agg(F.sum("n").alias("n"))
    return by_source.groupBy("term", *by, "total").agg(F.sum("n").alias("frequency"), F.count(F.lit(1)).alias("source_count"))


def word_cloud(terms: DataFrame, min_sources: int = 2, limit: int = 50) -> DataFrame:
    """term, frequency, source_count and weight (against the first) of the most frequent terms."""
    top = counted(terms, most_frequent(terms, min_sources, limit))
    peak = top.agg(F.max("frequency").alias("_top"))
    weight = F.when(F.col("_top") == 0, 0.0).otherwise(metrics.rounded(F.col("frequency") / F.nullif("_top", F.lit(0)), 3))
    return top.crossJoin(peak).select("term", "frequency", "source_count", weight.alias("weight"))  # one row


def cloud_sources(terms: DataFrame, cloud: DataFrame) -> DataFrame:
    """term and source_id (as text) of all facts of the cloud's terms."""
    return terms.join(F.broadcast(cloud.select("term")), "term").select("term", F.col("source_id").cast("string").alias("source_id"))


def source_samples(terms: DataFrame, cloud: DataFrame, most: int = SAMPLE) -> DataFrame:
    """term and source_id: the first `most` sources of each term of the cloud, by id as text.

    The rank's limit is applied before the shuffle, so a term's whole list is never gathered. Rows of one source have one rank.
    """
    order = Window.partitionBy("term").orderBy("source_id")
    return cloud_sources(terms, cloud).withColumn("_rank", F.dense_rank().over(order)).filter(F.col("_rank") <= most).select("term", "source_id").distinct()


def trend(terms: DataFrame, bucket: str, min_sources: int = 2, limit: int = 20) -> DataFrame:
    """term, bucket, frequency, source_count, total of the terms that have the most in all and enough sources."""
    return counted(terms.withColumn("bucket", F.col(bucket)), most_frequent(terms, min_sources, limit), "bucket")


def zero_filled_trend(series: DataFrame, spine: DataFrame) -> DataFrame:
    grid = series.select("term", "total").distinct().crossJoin(spine.select("bucket"))  # both are short lists
    return grid.join(series.drop("total"), ["term", "bucket"], "left").fillna(0, ["frequency", "source_count"])


def comparison(filled: DataFrame) -> DataFrame:
    """The last bucket against the one before; no rows if there's one bucket."""
    order = Window.partitionBy("term").orderBy("bucket")
    last = filled.withColumns({"previous": F.lag("frequency", 1).over(order), "_next": F.lead("bucket", 1).over(order)}).filter(F.col("_next").isNull() & F.col("previous").isNotNull())
    now, was = F.col("frequency"), F.col("previous")
    return last.select(
        "term", now.alias("current"), "previous", (now - was).alias("change"), metrics.change_percent(now, was).alias("change_percent"), metrics.direction(now, was).alias("direction"),
        F.when((was == 0) & (now > 0), "emerging").when((was > 0) & (now == 0), "fading").alias("movement"),
    )


def pivoted(filled: DataFrame, plotted: list[str]) -> DataFrame:
    """One row for each bucket, a column for each plotted term."""
    return filled.groupBy("bucket").pivot("term", plotted).agg(F.sum("frequency")).fillna(0)


def pair_jaccard(sources: DataFrame, least: float = 0.0) -> DataFrame:
    """term_a < term_b with the Jaccard similarity of all their sources, for pairs that share a source; `sources` may name one more than once.

    A source's terms meet in one row, and pairs are counted before the shuffle, so no term's list is gathered. A term's pair with itself counts its sources.
    """
    held = sources.groupBy("source_id").agg(F.sort_array(F.collect_set("term")).alias("terms"))  # of a source, at most the terms of the cloud
    each = held.select(F.posexplode("terms").alias("at", "term_a"), "terms").select("term_a", F.explode(F.slice("terms", F.col("at") + 1, F.size("terms"))).alias("term_b"))
    both = each.groupBy("term_a", "term_b").agg(F.count(F.lit(1)).alias("shared"))
    size = lambda x: F.max(F.when(F.col("term_a") == F.col("term_b"), F.col("shared"))).over(Window.partitionBy(x))
    like = F.col("shared") / (F.col("size_a") + F.col("size_b") - F.col("shared"))
    sized = both.withColumns({"size_a": size("term_a"), "size_b": size("term_b")}).filter(F.col("term_a") < F.col("term_b"))
    return sized.filter(like > least).select("term_a", "term_b", metrics.rounded(like, 6).alias("jaccard"))


def clusters(cloud: DataFrame, samples: DataFrame) -> DataFrame:
    """cluster, label, term, source_count: leader clustering of the first CLUSTER_TERMS terms in order of frequency.

    A term joins the cluster whose sources are most like its own, the first at a tie, if by more than
    NEARNESS and there's room; else it starts one, if there's room for that; else it's left out.
    """
    first = cloud.orderBy(F.desc("frequency"), "term").limit(CLUSTER_TERMS)
    lists = samples.join(first, "term").groupBy("term", "frequency").agg(F.sort_array(F.collect_list("source_id")).alias("sources"))  # SAMPLE at most

    def lead(g: pd.DataFrame) -> pd.DataFrame:
        found: list[dict] = []
        for row in g.sort_values(["frequency", "term"], ascending=[False, True]).itertuples():
            own = set(row.sources)
            rated = [(len(own & c["sources"]) / max(1, len(own | c["sources"])), -i) for i, c in enumerate(found)]
            best, at = max(rated, default=(0.0, 0))
            if best > NEARNESS:
                c = found[-at]
                if len(c["terms"]) < CLUSTER_SIZE:
                    c["terms"].append(row.term)
                    c["sources"] |= own
                    continue
            if len(found) < MOST_CLUSTERS:
                found.append({"terms": [row.term], "sources": own})
        rows = [(i, c["terms"][0][:1].upper() + c["terms"][0][1:], t, min(len(c["sources"]), SAMPLE)) for i, c in enumerate(found) for t in c["terms"]]
        return pd.DataFrame(rows, columns=["cluster", "label", "term", "source_count"])

    return lists.withColumn("all", F.lit(1)).groupBy("all").applyInPandas(lambda g: lead(g), "cluster long, label string, term string, source_count long")
