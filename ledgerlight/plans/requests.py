"""Requests as a user makes them: sections asked for, ranges with open edges, scopes, documents named, versions edited."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from ..functions import calendar
from ..functions.scope import contained, tenant_in
from ..operators import analytics, presented, reports, retrieval, rules, topics
from ..sources import collections as c
from . import catalogue as k
from .catalogue import CONTAINED_SQL, DOC_SQL, FIELD_SQL, FROM, NOW, RANGE_SQL, REPORT_SQL, SCOPE, SCOPE_SQL, TO, quarter, r, register
from .streams import users

SPINE_SQL = f"(SELECT DISTINCT {quarter('m')} AS bucket FROM generate_series(TIMESTAMP '{FROM}', TIMESTAMP '{TO}', INTERVAL 1 MONTH) AS t(m) UNION ALL SELECT NULL)"


def tables(spark, sf):
    """Rows of each section within the scope and range, each with its own clock."""
    bounds = calendar.half_open(FROM, TO)
    mine, when = tenant_in(F.col("tenant"), SCOPE), calendar.within(F.col("clock"), bounds)
    clocked = lambda rows, column: rows.withColumn("clock", F.col(column)).filter(when)
    return {
        "documents": clocked(c.documents(spark, sf).filter(mine), "created_at"), "extraction": clocked(c.fields(spark, sf).filter(mine), "created_at"),
        "reports": clocked(c.reports(spark, sf).filter(mine & F.col("status").isin("published", "archived")), "published_at"), "queries": clocked(c.queries(spark, sf).filter(contained(F.col("scope"), SCOPE)), "created_at"),
    }


def request(spark, sf, *sections):
    spine = calendar.spine(spark, *calendar.half_open(FROM, TO), "quarter")
    return analytics.requested(tables(spark, sf), sections, spine, "quarter")


def section_sql(name: str, table: str, measures: str, clock: str, where: str) -> str:
    rows = f"(SELECT *, {quarter(clock)} AS bucket FROM {table} WHERE {where} AND {RANGE_SQL.replace('created_at', clock)})"
    return f"{name} AS (SELECT bucket, {measures} FROM {rows} GROUP BY 1 UNION ALL SELECT NULL, {measures} FROM {rows})"


REQUEST_SQL = f"""{section_sql('d', 'docs', DOC_SQL, 'created_at', f'tenant IN {SCOPE_SQL}')},
{section_sql('e', 'fields', FIELD_SQL, 'created_at', f'tenant IN {SCOPE_SQL}')},
s AS {SPINE_SQL}
SELECT s.bucket, d.validated AS documents_validated, d.total AS documents_total, d.avg_ocr_confidence AS documents_avg_ocr_confidence, e.total_fields AS extraction_total_fields, e.corrected_documents AS extraction_corrected_documents, NULL::BIGINT AS reports_published,
 CASE WHEN s.bucket IS NULL THEN greatest(0.0::DOUBLE, {r("(validated - corrected_documents - awaiting_review)::DOUBLE / validated * 100.0")}) END AS automation,
 CASE WHEN s.bucket IS NULL THEN {r("greatest(0.0, (validated * 45.0::DOUBLE - overridden_fields * 3.0) / (validated * 45.0::DOUBLE) * 100.0)")} END AS time_saved
FROM s LEFT JOIN d ON s.bucket IS NOT DISTINCT FROM d.bucket LEFT JOIN e ON s.bucket IS NOT DISTINCT FROM e.bucket"""


@register("analytics_request", REQUEST_SQL, "docs", "fields")
def analytics_request(spark, sf):
    """Documents and extraction: buckets and totals; the ratios of both stand in the totals alone, and reports weren't asked for."""
    out = request(spark, sf, "documents", "extraction")
    return out.select("bucket", "documents_validated", "documents_total", "documents_avg_ocr_confidence", "extraction_total_fields", "extraction_corrected_documents", "reports_published", "automation", "time_saved")


@register("analytics_request_reports", section_sql("p", "reps", REPORT_SQL, "published_at", f"status IN ('published','archived') AND tenant IN {SCOPE_SQL}")
    + f",\ns AS {SPINE_SQL} SELECT s.bucket, published AS reports_published, NULL::DOUBLE AS automation, NULL::BIGINT AS queries_total FROM s LEFT JOIN p ON s.bucket IS NOT DISTINCT FROM p.bucket", "reps")
def analytics_request_reports(spark, sf):
    """Reports alone: no ratio of other sections, in the totals neither."""
    return request(spark, sf, "reports").select("bucket", "reports_published", "automation", "queries_total")


@register("range_one_edge", "SELECT count(*) FILTER (WHERE created_at >= TIMESTAMP '2023-12-31 18:30:00' AND created_at < TIMESTAMP '2024-02-01 00:00:00.001') AS from_alone, count(*) FILTER (WHERE created_at >= TIMESTAMP '2023-03-31 18:30:00' AND created_at < TIMESTAMP '2024-01-10 18:30:00') AS to_alone FROM qs", "qs")
def range_one_edge(spark, sf):
    """An edge that isn't given is that of the fiscal year to date, whatever the other one is."""
    now, at = datetime.fromisoformat(NOW), F.col("created_at")
    first, last = calendar.defaulted("2024-01-01", None, now), calendar.defaulted(None, "2024-01-10", now)
    return c.queries(spark, sf).agg(F.count_if(calendar.within(at, first)).alias("from_alone"), F.count_if(calendar.within(at, last)).alias("to_alone"))


@register("bucket_ranges", f"""k AS (SELECT DISTINCT {quarter('created_at')} AS key FROM docs UNION SELECT DISTINCT {k.month('created_at')} FROM docs),
l AS (SELECT key, CASE WHEN key[1:2] = 'FY' THEN make_timestamp(key[3:6]::BIGINT + CASE WHEN key[9:9] = '4' THEN 1 ELSE 0 END, (key[9:9]::BIGINT * 3) % 12 + 1, 1, 0, 0, 0) ELSE strptime(key || '-01', '%Y-%m-%d') END AS local FROM k)
SELECT key, local - INTERVAL 330 MINUTE AS gte, local + CASE WHEN key[1:2] = 'FY' THEN INTERVAL 3 MONTH ELSE INTERVAL 1 MONTH END - INTERVAL 330 MINUTE AS lt,
 CASE WHEN key[1:2] = 'FY' THEN CASE WHEN key[9:9] = '1' THEN 'FY' || (key[3:6]::BIGINT - 1)::VARCHAR || '-Q4' ELSE key[1:8] || (key[9:9]::BIGINT - 1)::VARCHAR END ELSE strftime(local - INTERVAL 1 DAY, '%Y-%m') END AS previous FROM l""", "docs")  # fmt: skip
def bucket_ranges(spark, sf):
    """Each month and quarter in which a document was made: its half-open range of instants, and the bucket before."""
    at = F.col("created_at")
    rows = c.documents(spark, sf)
    keys = rows.select(calendar.quarter_key(at).alias("key")).unionByName(rows.select(calendar.month_key(at).alias("key"))).distinct()
    return keys.select("key", calendar.bucket_start_of(F.col("key")).alias("gte"), calendar.bucket_end_of(F.col("key")).alias("lt"), calendar.previous_key_of(F.col("key")).alias("previous"))


@register("scopes_resolved", """SELECT c_custkey AS user_id, CASE WHEN held THEN CASE WHEN wanted IS NOT NULL THEN 'sub:' || wanted::VARCHAR WHEN admin THEN 'all' ELSE 'sub:' || array_to_string(g, ',') END END AS scope_key, CASE WHEN NOT held THEN 'not_found' END AS refusal
 FROM (SELECT *, wanted IS NULL OR admin OR list_contains(g, wanted) AS held FROM (SELECT c_custkey, c_mktsegment = 'BUILDING' AS admin, list_sort([c_nationkey % 5, (c_nationkey + 1) % 5, (c_nationkey + 2) % 5]) AS g, CASE WHEN c_custkey % 3 <> 0 THEN c_custkey % 5 END AS wanted FROM customer))""")
def scopes_resolved(spark, sf):
    """What each user may see: a tenant they ask for, all, or what they hold, sorted."""
    wanted = F.when(F.col("user_id") % 3 != 0, F.col("user_id") % 5)
    return rules.resolved(users(spark, sf), wanted).select("user_id", "scope_key", "refusal")


@register("asked_documents_check", """asked AS (SELECT id, scope, CASE id % 4 WHEN 0 THEN [id * 4 + 1, id * 4 + 2] WHEN 1 THEN [id * 4 + 1, id * 4 + 1] WHEN 2 THEN [id * 4 + 3] ELSE [] END AS ids FROM qs),
f AS (SELECT a.id, count(*) AS n, count(*) FILTER (WHERE d.status = 'validated') AS good FROM (SELECT DISTINCT id, scope, unnest(ids) AS doc FROM asked) a JOIN docs d ON d.id = a.doc AND list_contains(a.scope, d.tenant) GROUP BY 1)
SELECT asked.id, CASE WHEN len(scope) = 0 THEN 'invalid_request' WHEN coalesce(n, 0) <> len(ids) THEN 'not_found' WHEN coalesce(good, 0) <> coalesce(n, 0) THEN 'invalid_request' END AS refusal FROM asked LEFT JOIN f USING (id)""", "qs", "docs")
def asked_documents_check(spark, sf):
    """Documents that questions name: as many have to be found as are listed, so a repeated one refuses the question."""
    i = F.col("id")
    listed = F.when(i % 4 == 0, F.array(i * 4 + 1, i * 4 + 2)).when(i % 4 == 1, F.array(i * 4 + 1, i * 4 + 1)).when(i % 4 == 2, F.array(i * 4 + 3)).otherwise(F.array().cast("array<bigint>"))
    asked = c.queries(spark, sf).select("id", "scope", listed.alias("document_ids"))
    return rules.usable_as_listed(asked, c.documents(spark, sf).select(F.col("id").alias("document_id"), "tenant", "status"))


@register("auto_tags", "SELECT id, array_to_string(list_sort(list_distinct([code, strftime(created_at, '%Y-%m'), type, 'of ' || (id % 3)::VARCHAR, type])), ',') AS tags FROM docs JOIN subs USING (tenant)", "docs", "subs")
def auto_tags(spark, sf):
    """Code, month of UTC and type, and the uploader's own tags, each once."""
    docs = c.documents(spark, sf).join(c.subsidiaries(spark, sf), "tenant")
    own = F.array(F.concat(F.lit("of "), (F.col("id") % 3).cast("string")), F.col("type"))
    return docs.select("id", F.array_join(F.array_sort(rules.auto_tags(F.col("code"), F.col("created_at"), F.col("type"), own)), ",").alias("tags"))


@register("report_versions_appended", """v AS (SELECT document_id AS report_id, 1::BIGINT AS version, list(l_partkey ORDER BY l_linenumber, l_partkey, l_quantity) AS sections FROM fields GROUP BY 1)
SELECT report_id, version, len(sections) AS sections FROM v UNION ALL SELECT report_id, 2, len(sections) + 1 FROM v JOIN reps ON reps.id = report_id WHERE status = 'draft' AND report_id % 3 = 0""", "fields", "reps")
def report_versions_appended(spark, sf):
    """A draft's edit (here: of each third report, a section more; of the others, the same sections) adds a version with its sections."""
    lines = c.fields(spark, sf).groupBy(F.col("document_id").alias("report_id")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_quantity"))).alias("of"))
    versions = lines.select("report_id", F.lit(1).cast("long").alias("version"), F.transform("of", lambda x: x["l_partkey"]).alias("sections"), F.lit(7).cast("long").alias("created_by"), F.lit(NOW).cast("timestamp_ntz").alias("created_at"))
    drafts = c.reports(spark, sf).filter("status = 'draft'").select(F.col("id").alias("report_id"))
    edits = versions.join(drafts, "report_id").select("report_id", F.when(F.col("report_id") % 3 == 0, F.array_append("sections", F.lit(0).cast("long"))).otherwise(F.col("sections")).alias("sections"))
    return reports.appended_versions(versions, edits, F.lit(8).cast("long"), F.lit(NOW).cast("timestamp_ntz")).select("report_id", "version", F.size("sections").cast("long").alias("sections"))


@register("fields_in_order", "SELECT document_id, l_partkey AS part, row_number() OVER (PARTITION BY document_id ORDER BY 'part ' || l_partkey::VARCHAR, l_linenumber, l_quantity) AS place, l_linenumber::BIGINT AS line FROM fields", "fields")
def fields_in_order(spark, sf):
    """A document's fields by name."""
    from pyspark.sql import Window

    order = Window.partitionBy("document_id").orderBy(F.concat(F.lit("part "), F.col("l_partkey").cast("string")), "l_linenumber", "l_quantity")
    return c.fields(spark, sf).select("document_id", F.col("l_partkey").alias("part"), F.row_number().over(order).cast("long").alias("place"), F.col("l_linenumber").cast("long").alias("line"))


@register("claimed_refs", "SELECT question_id, array_to_string(regexp_extract_all(t, '\\{\\{ref:(S\\d{1,3})\\}\\}', 1), ',') AS refs FROM (SELECT item_id AS question_id, text[1:20] || ' {{ref:S' || item_id::VARCHAR || '}} {{ref:S1234}} {{ref:s1}}{{ref:S2}}' || text[21:40] || '{{ ref:S3}} {{ref:S' || (item_id % 3)::VARCHAR || '}}' AS t FROM benchmark)")
def claimed_refs(spark, sf):
    """The references that an answer claims, in order, repeats kept; marks of other shapes are none."""
    i = F.col("question_id")
    said = F.concat(F.substring("text", 1, 20), F.lit(" {{ref:S"), i.cast("string"), F.lit("}} {{ref:S1234}} {{ref:s1}}{{ref:S2}}"), F.substring("text", 21, 20), F.lit("{{ ref:S3}} {{ref:S"), (i % 3).cast("string"), F.lit("}}"))
    return c.questions(spark, sf).select("question_id", F.array_join(retrieval.claimed_refs(said), ",").alias("refs"))


MOVES_SQL = k.COMPARE_SQL.replace(">= 2 ORDER BY 2 DESC, 1 LIMIT 20", ">= 1 ORDER BY 2 DESC, 1 LIMIT 4000")


@register("topic_movements", f"SELECT term, movement, current, previous FROM ({MOVES_SQL}) WHERE movement IS NOT NULL", "wf")
def topic_movements(spark, sf):
    """Among rarer terms too: those that the last month has and the one before had not, and the reverse."""
    months = calendar.spine(spark, *calendar.half_open(k.TERM_FROM, k.TERM_TO), "month")
    filled = topics.zero_filled_trend(topics.trend(k.terms(spark, sf), "period_month", 1, 4000), months)
    return topics.comparison(filled).filter(F.col("movement").isNotNull()).select("term", "movement", "current", "previous")


@register("presented_documents", "SELECT id, tenant, type, status, ocr_confidence, requires_review, coalesce(injection_suspected, false) AS injection_suspected, 0::BIGINT AS tags, NULL::VARCHAR AS processing_error FROM docs", "docs")
def presented_documents(spark, sf):
    """A document's shape: flags have their defaults, and what is the library's own stays inside."""
    rows = presented.shaped(c.documents(spark, sf).withColumns({"storage_key": F.lit("5/x"), "rules": F.lit("role-reassignment")}), presented.DOCUMENT)
    return rows.select("id", "tenant", "type", "status", "ocr_confidence", "requires_review", "injection_suspected", F.size("tags").cast("long").alias("tags"), "processing_error")


@register("presented_query_summaries", f"""SELECT id, status, review_status, 'answer of ' || id::VARCHAR AS answer_preview, len(list_filter(scope, lambda t: t IN {SCOPE_SQL})) AS citation_count, coalesce(discarded, 0) AS discarded, coalesce(injection_suspected, false) AS injection_suspected,
 CASE WHEN len(scope) = 1 THEN scope[1] END AS tenant FROM qs""", "qs")
def presented_query_summaries(spark, sf):
    """The log of questions: previews, and the citations that this reader may see counted."""
    cited = F.transform("scope", lambda t: F.struct(t.alias("tenant"), F.lit(1).alias("ordinal")))
    answer = F.rpad(F.concat(F.lit("answer of "), F.col("id").cast("string"), F.lit("|")), 300, "x")
    rows = c.queries(spark, sf).withColumns({"citations": cited, "response_text": answer})
    return presented.query_summaries(rows, SCOPE).select("id", "status", "review_status", F.substring_index("answer_preview", "|", 1).alias("answer_preview"), "citation_count", "discarded", "injection_suspected", "tenant")


@register("presented_reports", "SELECT id, tenant, status, has_unreviewed_figures, published_at, NULL::TIMESTAMP AS archived_at, 0::BIGINT AS documents FROM reps", "reps")
def presented_reports(spark, sf):
    rows = presented.shaped(c.reports(spark, sf), presented.REPORT)
    return rows.select("id", "tenant", "status", "has_unreviewed_figures", "published_at", "archived_at", F.size("document_ids").cast("long").alias("documents"))
