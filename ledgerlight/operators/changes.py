"""Changes of derived tables, as the resulting rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_ATTEMPTS = 3


def replaced_by_source(old: DataFrame, new: DataFrame, keys: list[str], sources: DataFrame | None = None) -> DataFrame:
    """Rows of the sources that were indexed again give way, also where nothing new came of them. Doing it twice changes nothing."""
    gone = (sources if sources is not None else new).select(*keys).distinct()
    return old.join(gone, keys, "left_anti").unionByName(new)


def kept_on_reprocess(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Derived rows of reprocessed documents give way to new ones, but for those that a person has overridden."""
    again = new.select(key).distinct()
    kept = old.join(again, key, "left_anti").unionByName(old.join(again, key, "left_semi").filter(F.col("overridden_by").isNotNull()))
    return kept.unionByName(new, allowMissingColumns=True)


def appended(table: DataFrame, rows: DataFrame) -> DataFrame:
    """The table with rows added; columns that they lack are null."""
    return table.unionByName(rows, allowMissingColumns=True)


def requeued(documents: DataFrame) -> DataFrame:
    """Documents in work at a restart are queued again."""
    return documents.withColumn("status", F.when(F.col("status") == "processing", "queued").otherwise(F.col("status")))


def overridden(fields: DataFrame, which: Column, value: Column, by: Column, reason: Column | None = None, at: Column | None = None) -> DataFrame:
    """A corrected value, with its reason and time; what was first read stays as original_value, and other rows as they are.

    override_reason and overridden_at are added where they're given and not there yet. A correction without a reason has none, whatever
    reason an earlier one had.
    """

    def set_where(name: str, new: Column | None, kind: str) -> dict[str, Column]:
        held = F.col(name) if name in fields.columns else F.lit(None).cast(kind)
        return {name: F.when(which, F.lit(None) if new is None else new).otherwise(held)} if new is not None or name in fields.columns else {}

    return fields.withColumns({
        **set_where("override_reason", reason, "string"), **set_where("overridden_at", at, "timestamp_ntz"),
        "original_value": F.when(which, F.coalesce("original_value", "value")).otherwise(F.col("original_value")),
        "value": F.when(which, value).otherwise(F.col("value")), "overridden_by": F.when(which, by).otherwise(F.col("overridden_by")),
    })


def recovered(queries: DataFrame, stuck_before: Column) -> DataFrame:
    """Work in flight at a restart: exhausted and late is given up, all else is queued again."""
    flight = F.col("status").isin("retrieving", "answering")
    dead = flight & (F.col("attempts") >= F.col("max_attempts")) & F.col("processing_started_at").isNotNull() & (F.col("processing_started_at") < stuck_before)
    return queries.withColumn("status", F.when(dead, "dead_lettered").when(flight, "queued").otherwise(F.col("status")))


def retryable(status: Column, attempts: Column, most: int = MOST_ATTEMPTS) -> Column:
    return (status == "failed") & (attempts < most)


def inserted_if_absent(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    return table.unionByName(rows.join(table, keys, "left_anti"))


def unexpired(rows: DataFrame, now: Column) -> DataFrame:
    return rows.filter(F.col("expires_at") > now)
