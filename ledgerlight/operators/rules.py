"""Rules over documents and queries that a request is held against."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def all_usable(asked: DataFrame, documents: DataFrame) -> DataFrame:
    """asked (report_id, document_id) to report_id, usable, asked: all distinct documents have to be there and validated."""
    found = asked.distinct().join(documents, "document_id", "left").groupBy("report_id")
    good = F.sum(F.when(F.col("status") == "validated", 1).otherwise(0))
    return found.agg((good == F.count(F.lit(1))).alias("usable"), F.count(F.lit(1)).alias("asked"))


def usable_as_listed(asked: DataFrame, documents: DataFrame) -> DataFrame:
    """asked (id, scope, document_ids) to id, refusal: as all_usable, but for questions.

    As many documents have to be found within the scope as are listed, so one that is listed twice is not found; then all have to be validated. An
    empty list is fine. documents: document_id, tenant, status.
    """
    each = asked.select("id", "scope", F.explode(F.array_distinct("document_ids")).alias("document_id")).join(documents, "document_id").filter(F.array_contains("scope", F.col("tenant")))
    found = each.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "validated").alias("good"))
    n = F.coalesce("n", F.lit(0))
    listed = F.greatest(F.size(F.coalesce("document_ids", F.array().cast("array<bigint>"))), F.lit(0))
    return asked.join(found, "id", "left").select("id", F.when(F.size("scope") == 0, "invalid_request").when(n != listed, "not_found").when(F.coalesce("good", F.lit(0)) != n, "invalid_request").alias("refusal"))


def resolved(users: DataFrame, requested: Column) -> DataFrame:
    """users (role, grants) with scope_key and scope (null: all tenants), or a refusal where a tenant is requested that they don't hold."""
    admin = F.col("role") == "admin"
    grants = F.array_sort(F.coalesce("grants", F.array().cast("array<bigint>")))
    held = requested.isNull() | admin | F.array_contains(grants, requested)
    listed = F.array_join(F.transform(grants, lambda x: x.cast("string")), ",")
    key = F.when(requested.isNotNull(), F.concat(F.lit("sub:"), requested.cast("string"))).when(admin, "all").otherwise(F.concat(F.lit("sub:"), F.when(listed == "", "none").otherwise(listed)))
    scope = F.when(requested.isNotNull(), F.array(requested)).when(~admin, grants)
    return users.withColumns({"scope_key": F.when(held, key), "scope": F.when(held, scope), "refusal": F.when(~held, "not_found")})


def all_known(rows: DataFrame, tenants: DataFrame) -> DataFrame:
    """rows (id, scope) to id, known: whether each tenant of the scope is there."""
    each = rows.select("id", F.explode("scope").alias("tenant")).join(tenants.withColumn("_there", F.lit(1)), "tenant", "left")
    return each.groupBy("id").agg((F.count("_there") == F.count(F.lit(1))).alias("known"))


def asked(queries: DataFrame) -> DataFrame:
    """New queries: a scope of one tenant is also kept as such, and parliamentary ones wait for a review."""
    return queries.filter(F.size("scope") > 0).withColumns({
        "tenant": F.when(F.size("scope") == 1, F.element_at("scope", 1)),
        "review_status": F.when(F.col("is_parliamentary"), "pending").otherwise("not_required"), "status": F.lit("queued"),
    })


def auto_tags(code: Column, created_at: Column, kind: Column, own: Column) -> Column:
    """The tenant's code, the month of UTC (unlike the buckets') and the type, then the uploader's own tags, each once."""
    day = created_at.cast("date")
    return F.array_distinct(F.concat(F.array(code, F.format_string("%04d-%02d", F.year(day), F.month(day)), kind), F.coalesce(own, F.array().cast("array<string>"))))


def review_refusal(status: Column, wanted: Column, is_admin: Column) -> Column:
    """Why a review is refused, null where it isn't: approving is for administrators, and a review (a wanted review status) for queries with an answer.

    Changes that set no review status (wanted is null) are never refused for these reasons.
    """
    forbidden = (wanted == "approved") & ~is_admin
    return F.when(forbidden, "forbidden").when(wanted.isNotNull() & ~status.isin("answered", "unsupported"), "invalid_request")


def reviewed(queries: DataFrame, wanted: Column, by: Column, at: Column, is_admin: Column) -> DataFrame:
    """Queries (status, review_status, reviewed_by, reviewed_at) after a review; where it's refused, as they were, with `refusal`."""
    goes = F.col("refusal").isNull() & F.col("_wanted").isNotNull()
    rows = queries.withColumns({"_wanted": wanted, "refusal": review_refusal(F.col("status"), wanted, is_admin)})
    return rows.withColumns({
        "review_status": F.when(goes, F.col("_wanted")).otherwise(F.col("review_status")), "reviewed_by": F.when(goes, by).otherwise(F.col("reviewed_by")),
        "reviewed_at": F.when(goes, at).otherwise(F.col("reviewed_at")),
    }).drop("_wanted")
