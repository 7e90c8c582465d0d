"""Lists: optional filters, keyset and offset pages, visibility; the dashboard's lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokens, tokens_of


def filtered(rows: DataFrame, **equal) -> DataFrame:
    """Rows that equal every filter that is given."""
    for name, value in equal.items():
        if value is not None:
            rows = rows.filter(F.col(name) == F.lit(value))
    return rows


def keyset_page(rows: DataFrame, key: str, limit: int, before=None) -> DataFrame:
    """The newest `limit` rows before a cursor, and whether more follow. A row that comes later moves no page."""
    if before is not None:
        rows = rows.filter(F.col(key) < F.lit(before))
    more = rows.orderBy(F.col(key).desc()).limit(limit + 1)
    flagged = more.agg(F.count(F.lit(1)).alias("_n")).select((F.col("_n") > limit).alias("has_more"))
    return more.orderBy(F.col(key).desc()).limit(limit).crossJoin(flagged)  # one row


def offset_page(rows: DataFrame, order: list[Column], page: int, limit: int) -> DataFrame:
    total = rows.agg(F.count(F.lit(1)).alias("total")).select("total", F.ceil(F.col("total") / limit).cast("long").alias("total_pages"))
    return rows.orderBy(*order).offset((page - 1) * limit).limit(limit).crossJoin(total)  # one row


def by_key(rows: DataFrame, key: str, value) -> DataFrame:
    """The row of a key, if the rows, scoped before, hold it."""
    return rows.filter(F.col(key) == F.lit(value)).limit(1)


def visible_templates(rows: DataFrame, grants: Sequence[int] | None) -> DataFrame:
    """Templates (tenants: an array) of no tenant, or of a granted one."""
    if grants is None:
        return rows
    held = F.array(*[F.lit(g) for g in grants]).cast("array<bigint>")
    return rows.filter((F.size("tenants") == 0) | F.arrays_overlap("tenants", held))


def text_search(rows: DataFrame, key: str, weights: dict[str, int], asked: str) -> DataFrame:
    """key and score of the rows whose columns hold any of the asked terms: occurrences times the column's weight."""
    terms = tokens_of(asked)
    found = lambda name: F.size(F.filter(F.coalesce(tokens(F.col(name)), F.array().cast("array<string>")), lambda t: t.isin(*terms)))
    score = sum((found(name) * weight for name, weight in weights.items()), F.lit(0)).cast("long")
    return rows.select(key, score.alias("score")).filter("score > 0")


def visible_logs(logs: DataFrame, user: int, grants: Sequence[int] | None, asked_user: int | None = None) -> DataFrame:
    """A reader sees rows of granted tenants and own rows; an administrator (None) all.

    asked_user: only that user's rows; for a reader, any other than the reader is not found.
    """
    if asked_user is not None:
        if grants is not None and asked_user != user:
            raise LookupError("no such user")
        logs = logs.filter(F.col("user_id") == asked_user)
    return logs if grants is None else logs.filter(F.col("tenant").isin(*grants) | (F.col("user_id") == user))


def recent(rows: DataFrame, clock: str, key: str, limit: int = 5) -> DataFrame:
    return rows.orderBy(F.col(clock).desc(), F.col(key).desc()).limit(limit)


def pending_work(documents: DataFrame, queries: DataFrame, limit: int = 5) -> DataFrame:
    """What waits for a person: each queue's newest, merged; documents first where the time is equal."""
    d = documents.filter((F.col("requires_review") & (F.col("status") == "validated")) | (F.col("status") == "failed"))
    q = queries.filter((F.col("review_status") == "pending") | F.col("status").isin("failed", "dead_lettered"))
    # fixed values: the reasons
    d = recent(d, "created_at", "id", limit).select(
        F.lit("document").alias("kind"), "id", "status", F.when(F.col("status") == "failed", "Processing failed — retry available").otherwise("Low-confidence extraction").alias("reason"),
        "tenant", "created_at",
    )
    q = recent(q, "created_at", "id", limit).select(
        F.lit("query").alias("kind"), "id", "status",
        F.when(F.col("status") == "dead_lettered", "Generation failed repeatedly; manual review required").when(F.col("status") == "failed", "Generation failed — retry available").otherwise("Answer awaiting review").alias("reason"),
        F.when(F.size("scope") == 1, F.element_at("scope", 1)).alias("tenant"), "created_at",
    )
    return d.unionByName(q).orderBy(F.col("created_at").desc(), "kind", F.col("id").desc()).limit(limit)


def grouped_actions(logs: DataFrame) -> DataFrame:
    """Actions by the part of their name before the dot."""
    return logs.groupBy(F.split_part("action", F.lit("."), F.lit(1)).alias("domain")).agg(F.array_join(F.array_sort(F.collect_set("action")), ",").alias("actions"), F.count(F.lit(1)).alias("n"))
