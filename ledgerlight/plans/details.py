"""More of the catalogue: presentation columns, rule predicates, look-ups and hashes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.calendar import month_key
from ..functions.metrics import rounded
from ..operators import changes, ingest, listing
from ..sources import collections as c
from .catalogue import SCOPE, SCOPE_SQL, r, register


@register("audit_actions_grouped", "SELECT string_split(action, 'i')[1] AS domain, array_to_string(list_sort(list_distinct(list(action))), ',') AS actions, count(*) AS n FROM (SELECT replace(action, 'i', '.') AS action2, action FROM logs) GROUP BY 1", "logs")
def audit_actions_grouped(spark, sf):
    """The corpus's actions have no dot; their first i stands for it."""
    logs = c.audit_logs(spark, sf).withColumn("plain", F.col("action")).withColumn("action", F.regexp_replace("action", "i", "."))
    return listing.grouped_actions(logs).withColumn("actions", F.regexp_replace("actions", r"\.", "i"))


@register("query_warnings", """SELECT id, array_to_string(list_filter([CASE WHEN withheld > 0 THEN 'withheld:' || withheld::VARCHAR END, CASE WHEN discarded > 0 THEN 'discarded:' || discarded::VARCHAR END,
 CASE WHEN status = 'unsupported' THEN 'unsupported' END], lambda x: x IS NOT NULL), ';') AS warnings FROM qs""", "qs")  # fmt: skip
def query_warnings(spark, sf):
    """Loss that a reader has to see: what was withheld, discarded or not supported."""
    of = lambda name: F.when(F.col(name) > 0, F.concat(F.lit(f"{name}:"), F.col(name).cast("string")))
    marks = F.array_compact(F.array(of("withheld"), of("discarded"), F.when(F.col("status") == "unsupported", "unsupported")))
    return c.queries(spark, sf).select("id", F.array_join(marks, ";").alias("warnings"))


@register("document_tags", "SELECT id, array_to_string(list_distinct_sorted, ',') AS tags FROM (SELECT id, list_sort(list_distinct([code, strftime(created_at, '%Y-%m'), type])) AS list_distinct_sorted FROM docs JOIN subs USING (tenant))", "docs", "subs")
def document_tags(spark, sf):
    """Code, month (of UTC, unlike the buckets) and type."""
    docs = c.documents(spark, sf).join(c.subsidiaries(spark, sf), "tenant")
    day = F.col("created_at").cast("date")
    tags = F.array_sort(F.array_distinct(F.array("code", F.format_string("%04d-%02d", F.year(day), F.month(day)), "type")))
    return docs.select("id", F.array_join(tags, ",").alias("tags"))


@register("documents_retryable", "SELECT id, status = 'failed' AND id % 5 < 3 AS retryable, status IN ('queued','processing') AS pending FROM docs", "docs")
def documents_retryable(spark, sf):
    return c.documents(spark, sf).select("id", changes.retryable(F.col("status"), F.col("id") % 5).alias("retryable"), F.col("status").isin("queued", "processing").alias("pending"))


@register("type_shares", f"SELECT type, n, floor(n * 100.0::DOUBLE / sum(n) OVER () + 0.5) AS percent, {r('n::DOUBLE / max(n) OVER ()', 3)} AS bar FROM (SELECT type, count(*) AS n FROM docs GROUP BY 1)", "docs")
def type_shares(spark, sf):
    counts = c.documents(spark, sf).groupBy("type").agg(F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy(F.lit(0))  # a row for each type
    return counts.select("type", "n", F.floor(F.col("n") * 100.0 / F.sum("n").over(whole) + 0.5).cast("double").alias("percent"), rounded(F.col("n") / F.max("n").over(whole), 3).alias("bar"))


@register("font_sizes", f"SELECT type, floor(12.0::DOUBLE + sqrt(n::DOUBLE / (SELECT count(*) FROM docs)) * 28.0 + 0.5) AS size FROM (SELECT type, count(*) AS n FROM docs GROUP BY 1)", "docs")
def font_sizes(spark, sf):
    docs = c.documents(spark, sf)
    counts = docs.groupBy("type").agg(F.count(F.lit(1)).alias("n")).crossJoin(docs.agg(F.count(F.lit(1)).alias("all")))  # one row
    return counts.select("type", F.floor(12.0 + F.sqrt(F.col("n") / F.col("all")) * 28.0 + 0.5).cast("double").alias("size"))


@register("cache_keys", "SELECT tenant, sha256(concat_ws(chr(0), 'analytics', '1', tenant::VARCHAR, code)) AS key, sha256(code)[1:12] AS fingerprint FROM subs", "subs")
def cache_keys(spark, sf):
    key = F.sha2(F.concat_ws("\0", F.lit("analytics"), F.lit("1"), F.col("tenant").cast("string"), F.col("code")), 256)
    return c.subsidiaries(spark, sf).select("tenant", key.alias("key"), F.left(F.sha2(F.col("code"), 256), F.lit(12)).alias("fingerprint"))


@register("checksums", "SELECT doc_id, sha256(text) AS checksum FROM documents")
def checksums(spark, sf):
    return c.read(spark, sf, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("checksum"))


@register("source_documents_check", "SELECT o_orderkey AS id, d.status = 'validated' AS usable FROM orders o JOIN docs d ON o_orderkey = d.id WHERE o_orderpriority = '2-HIGH'", "docs")
def source_documents_check(spark, sf):
    """Documents that reports name: usable only if they're validated."""
    asked = c.read(spark, sf, "orders").filter(F.col("o_orderpriority") == "2-HIGH").select(F.col("o_orderkey").alias("id"))
    return asked.join(c.documents(spark, sf), "id").select("id", (F.col("status") == "validated").alias("usable"))


@register("queries_still_authorised", "SELECT id, list_has_all([asked_by % 5, (asked_by + 1) % 5], scope) AS authorised FROM qs", "qs")
def queries_still_authorised(spark, sf):
    """The asker's grants now (two tenants each) hold the whole scope."""
    q = c.queries(spark, sf)
    users = q.select("asked_by").distinct().withColumn("grants", F.array(F.col("asked_by") % 5, (F.col("asked_by") + 1) % 5))
    return q.join(users, "asked_by").select("id", (F.size(F.array_except("scope", "grants")) == 0).alias("authorised"))


@register("fields_low_confidence", "SELECT document_id, count(*) AS n, bool_or(confidence <= 0.75) AS any_low, count(DISTINCT l_partkey) <> count(*) AS repeats FROM fields GROUP BY 1", "fields")
def fields_low_confidence(spark, sf):
    return c.fields(spark, sf).groupBy("document_id").agg(F.count(F.lit(1)).alias("n"), F.bool_or(F.col("confidence") <= 0.75).alias("any_low"), (F.countDistinct("l_partkey") != F.count(F.lit(1))).alias("repeats"))


@register("citations_distinct", "SELECT document_id, l_partkey AS field, min(l_linenumber)::BIGINT AS first_line FROM fields GROUP BY 1, 2", "fields")
def citations_distinct(spark, sf):
    """A document's repeated citations of a field are one, the first."""
    order = Window.partitionBy("document_id", "l_partkey").orderBy("l_linenumber")
    rows = c.fields(spark, sf).withColumn("_n", F.row_number().over(order)).filter("_n = 1")
    return rows.select("document_id", F.col("l_partkey").alias("field"), F.col("l_linenumber").cast("long").alias("first_line"))


@register("question_terms_by_month", f"SELECT strftime(source_created_at + INTERVAL 330 MINUTE, '%Y-%m') AS bucket, count(*) AS questions FROM term_sources WHERE source_type = 'query' AND tenant IN {SCOPE_SQL} GROUP BY 1", "term_sources")
def question_terms_by_month(spark, sf):
    rows = c.term_sources(spark, sf).filter((F.col("source_type") == "query") & F.col("tenant").isin(*SCOPE))
    return rows.groupBy(month_key(F.col("source_created_at")).alias("bucket")).agg(F.count(F.lit(1)).alias("questions"))


@register("text_gate", "SELECT page_id, k < 0.05::DOUBLE * least(8192, k + octet_length(encode(html))) AS accepted FROM (SELECT page_id, html, page_id % 10 * 60 AS k FROM pages)")
def text_gate(spark, sf):
    """Pages as text files that begin with control bytes: those with a twentieth or more of them in their first 8 KiB are refused."""
    head = F.repeat(F.lit("\x01"), (F.col("page_id") % 10 * 60).cast("int"))
    files = c.read(spark, sf, "pages").select("page_id", F.lit("page.txt").alias("path"), F.lit("text/plain").alias("mime"), F.concat(head, F.col("html")).cast("binary").alias("content"))
    return ingest.gated(files).select("page_id", "accepted")
