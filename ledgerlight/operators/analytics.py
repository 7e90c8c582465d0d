"""Analytics sections: measures by bucket, by type, by tenant and in total, in one pass over the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import metrics
from ..functions.calendar import bucket_key


def count_if(condition: Column) -> Column:
    return F.sum(F.when(condition, 1).otherwise(0))


def mean(column: str, scale: int) -> Column:
    """A rounded mean; the sixth decimal comes first, so that no order of summation moves a half."""
    return metrics.rounded(metrics.rounded(F.avg(column), 6), scale)


def document_measures() -> dict[str, Column]:
    status = F.col("status")
    return {
        "total": F.count(F.lit(1)),
        "validated": count_if(status == "validated"),
        "failed": count_if(status == "failed"),
        "in_progress": count_if(status.isin("queued", "processing")),
        "requires_review": count_if(F.col("requires_review")),
        "awaiting_review": count_if((status == "validated") & F.col("requires_review")),
        "injection_flagged": count_if(F.col("injection_suspected")),
        "avg_ocr_confidence": mean("ocr_confidence", 2),
    }


def extraction_measures(low: float = metrics.LOW_CONFIDENCE) -> dict[str, Column]:
    overridden = F.col("overridden_by").isNotNull()
    return {
        "total_fields": F.count(F.lit(1)),
        "overridden_fields": count_if(overridden),
        "corrected_documents": F.countDistinct(F.when(overridden, F.col("document_id"))),
        "avg_confidence": mean("confidence", 2),
        "low_confidence": count_if(F.col("confidence") <= low),
    }


def report_measures() -> dict[str, Column]:
    return {"published": F.count(F.lit(1)), "with_unreviewed_figures": count_if(F.col("has_unreviewed_figures"))}


def query_measures() -> dict[str, Column]:
    status = F.col("status")
    return {
        "total": F.count(F.lit(1)),
        **{name: count_if(status == name) for name in ("answered", "unsupported", "failed", "dead_lettered")},
        "parliamentary": count_if(F.col("is_parliamentary")),
        "pending_review": count_if(F.col("review_status") == "pending"),
        "with_citations": count_if((status == "answered") & (F.col("citation_count") > 0)),
        "citations_accepted": F.coalesce(F.sum("citation_count"), F.lit(0)),
        "citations_discarded": F.coalesce(F.sum("discarded"), F.lit(0)),
        "injection_suspected": count_if(F.col("injection_suspected")),
        "passages_withheld": F.coalesce(F.sum("withheld"), F.lit(0)),
        "avg_generation_ms": mean("generation_ms", 0),
    }


def _named(measures: dict[str, Column]) -> list[Column]:
    return [c.alias(n) for n, c in measures.items()]


def series(rows: DataFrame, clock: str, granularity: str, measures: dict[str, Column]) -> DataFrame:
    return rows.groupBy(bucket_key(F.col(clock), granularity).alias("bucket")).agg(*_named(measures))


def totals(rows: DataFrame, measures: dict[str, Column]) -> DataFrame:
    return rows.agg(*_named(measures))


def facets(rows: DataFrame, clock: str, granularity: str, sets: Sequence[Sequence[str]], measures: dict[str, Column]) -> DataFrame:
    """One scan for several groupings over bucket, type and tenant; `facet` names the grouping of a row.

    A distinct count of a total is its own, not the sum of the buckets'.
    """
    rows = rows.withColumn("bucket", bucket_key(F.col(clock), granularity))
    keys = list(dict.fromkeys(k for s in sets for k in s))
    facet = F.array_join(F.array_compact(F.array(*[F.when(F.grouping(k) == 0, F.lit(k)) for k in keys])), "+")
    return rows.groupingSets([[F.col(k) for k in s] for s in sets], *[F.col(k) for k in keys]).agg(facet.alias("facet"), *_named(measures))


def by_tenant_unwound(rows: DataFrame) -> DataFrame:
    """Queries for each tenant in their scope; one over three tenants counts for each, so this has no total."""
    return rows.select(F.explode("scope").alias("tenant")).groupBy("tenant").agg(F.count(F.lit(1)).alias("queries_asked"))


def breakdown(documents: DataFrame, extraction: DataFrame, reports: DataFrame, asked: DataFrame, names: DataFrame) -> DataFrame:
    """Tenants of any of four aggregates, with the counts of all; a tenant without a name is kept."""
    out = documents.join(extraction, "tenant", "full").join(reports, "tenant", "full").join(asked, "tenant", "full")
    counts = [c for c in out.columns if c != "tenant"]
    return out.fillna(0, counts).join(names, "tenant", "left").select("tenant", "code", *counts).orderBy(F.coalesce("code", F.lit("")), F.col("tenant").cast("string"))


WAITING = ["queued", "processing", "failed"]
UNFINISHED = ["queued", "retrieving", "answering", "failed", "dead_lettered"]


def document_health(rows: DataFrame) -> DataFrame:
    """Not bounded by dates: what has been stuck for long matters most."""
    return rows.filter(F.col("status").isin(WAITING)).groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.min("created_at").alias("oldest"))


def query_health(rows: DataFrame, stuck_before: Column) -> DataFrame:
    late = F.col("processing_started_at").isNotNull() & (F.col("processing_started_at") < stuck_before)
    return rows.filter(F.col("status").isin(UNFINISHED)).groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.min("created_at").alias("oldest"), count_if(late).alias("past_timeout"))


def age_seconds(oldest: Column, now: Column) -> Column:
    micros = F.unix_micros(now.cast("timestamp")) - F.unix_micros(oldest.cast("timestamp"))
    return F.greatest(F.lit(0), F.floor(micros / 1e6 + 0.5)).cast("long")


def health(documents: DataFrame, queries: DataFrame, now: Column) -> DataFrame:
    """Both queues as one row."""

    def of(status: str, column: str = "n", fold=F.sum) -> Column:
        return fold(F.when(F.col("status") == status, F.col(column)))

    zero = lambda c: F.coalesce(c, F.lit(0))
    d = documents.agg(*[zero(of(s)).alias(f"documents_{s}") for s in WAITING], age_seconds(of("queued", "oldest", F.min), now).alias("documents_oldest_age"))
    flight = F.col("status").isin("retrieving", "answering")
    q = queries.agg(
        *[zero(of(s)).alias(f"queries_{s}") for s in ("queued", "failed", "dead_lettered")],
        zero(F.sum(F.when(flight, F.col("n")))).alias("queries_in_flight"), zero(F.sum(F.when(flight, F.col("past_timeout")))).alias("queries_past_timeout"),
        age_seconds(of("queued", "oldest", F.min), now).alias("queries_oldest_age"),
    )
    return d.crossJoin(q)  # one row each


def cross_section_totals(documents: DataFrame, extraction: DataFrame) -> DataFrame:
    """Ratios that need both sections. They run on different clocks, so there are none for a bucket."""
    d = totals(documents, {k: v for k, v in document_measures().items() if k in ("validated", "awaiting_review")})
    e = totals(extraction, {k: v for k, v in extraction_measures().items() if k in ("total_fields", "overridden_fields", "corrected_documents")})
    c = F.col
    return d.crossJoin(e).select(  # one row each
        "*", metrics.accuracy(c("total_fields"), c("overridden_fields")).alias("accuracy"),
        metrics.automation(c("validated"), c("corrected_documents"), c("awaiting_review")).alias("automation"),
        metrics.time_saved(c("validated"), c("overridden_fields")).alias("time_saved"),
    )


SECTIONS = ("documents", "extraction", "reports", "queries")


def requested(tables: dict[str, DataFrame], sections: Sequence[str], spine: DataFrame, granularity: str) -> DataFrame:
    """bucket (null: the totals) and the asked sections' measures, each prefixed by its section; the ratios of two sections.

    tables: rows of each section within scope and range, with their clock as `clock`. A section that isn't asked has null for every measure and isn't read. A
    bucket in which nothing happened has nulls of its own. automation and time_saved need documents and extraction, which run on different
    clocks: they're null in every bucket, and in the totals too unless both sections are asked.
    """
    measures = {"documents": document_measures(), "extraction": extraction_measures(), "reports": report_measures(), "queries": query_measures()}
    out = spine.select("bucket").unionByName(spine.sparkSession.createDataFrame([(None,)], "bucket string"))
    for section in SECTIONS:
        named = [m.alias(f"{section}_{n}") for n, m in measures[section].items()]
        if section in sections:
            # one pass gives the buckets and the totals; Expand makes each row twice, before partial sums
            rows = tables[section].withColumn("bucket", bucket_key(F.col("clock"), granularity))
            found = rows.groupingSets([["bucket"], []], "bucket").agg(F.grouping("bucket").alias("_all"), *named)
            out = out.alias("o").join(found.filter("_all = 1 or bucket is not null").drop("_all").alias("f"), F.col("o.bucket").eqNullSafe(F.col("f.bucket")), "left").drop(F.col("f.bucket"))
        else:
            schema = tables[section].limit(0).agg(*named).schema
            out = out.withColumns({f.name: F.lit(None).cast(f.dataType) for f in schema})
    totals_of_both = F.col("bucket").isNull() & F.lit("documents" in sections and "extraction" in sections)
    return out.withColumns({
        "automation": F.when(totals_of_both, metrics.automation(F.col("documents_validated"), F.col("extraction_corrected_documents"), F.col("documents_awaiting_review"))),
        "time_saved": F.when(totals_of_both, metrics.time_saved(F.col("documents_validated"), F.col("extraction_overridden_fields"))),
    })
