"""The rest of the catalogue: look-ups, appends, visibility, searches, facets, orders, rules of documents, queries and reports."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import calendar, metrics, text
from ..functions.scope import contained, tenant_in
from ..operators import analytics, changes, ingest, listing, reports, rules, topics
from ..sources import collections as c
from . import catalogue as k
from .catalogue import CONTAINED_SQL, DOC_SQL, FIELD_SQL, NOW, QUERY_SQL, REPORT_SQL, SCOPE, SCOPE_SQL, count_if, month, quarter, r, register

# look-ups, appends, caches


@register("point_lookup", f"SELECT id, tenant, status FROM docs WHERE id IN (1, 2, 3, 4, 5, 6, 7) AND tenant IN {SCOPE_SQL}", "docs")
def point_lookup(spark, sf):
    """A few keys: only those within the scope are found."""
    rows = c.documents(spark, sf).filter(tenant_in(F.col("tenant"), SCOPE)).select("id", "tenant", "status")
    out = listing.by_key(rows, "id", 1)
    for key in range(2, 8):
        out = out.unionByName(listing.by_key(rows, "id", key))
    return out


SEEDS = [(0, "NOT SEEDED"), (11, "NORTH"), (12, "SOUTH")]


@register("seed_if_absent", "SELECT tenant, code FROM subs UNION ALL SELECT * FROM (VALUES (11::BIGINT, 'NORTH'), (12, 'SOUTH')) AS t(tenant, code)", "subs")
def seed_if_absent(spark, sf):
    return changes.inserted_if_absent(c.subsidiaries(spark, sf), spark.createDataFrame(SEEDS, "tenant long, code string"), ["tenant"])


@register("append_audit", "SELECT action, count(*) AS n, count(user_id) AS with_user FROM (SELECT action, user_id FROM logs UNION ALL SELECT 'document.failed', NULL FROM docs WHERE status = 'failed') GROUP BY 1", "logs", "docs")
def append_audit(spark, sf):
    """Entries without a user are taken too: an audit row never fails its caller."""
    failed = listing.filtered(c.documents(spark, sf), status="failed").select(F.lit("document.failed").alias("action"), F.col("tenant"))
    return changes.appended(c.audit_logs(spark, sf), failed).groupBy("action").agg(F.count(F.lit(1)).alias("n"), F.count("user_id").alias("with_user"))


@register("term_backfill", "SELECT source_id, count(*) AS terms, sum(n)::BIGINT AS n FROM wf WHERE source_type = 'document' AND source_id IN (SELECT document_id FROM parents WHERE status = 'validated') GROUP BY 1", "wf", "parents")
def term_backfill(spark, sf):
    sources = c.term_sources(spark, sf).filter("source_type = 'document'")
    good = c.parents(spark, sf).filter("status = 'validated'").select(F.col("document_id").alias("source_id"))
    terms = topics.word_frequencies(sources.join(good, "source_id", "left_semi"))
    return terms.groupBy("source_id").agg(F.count(F.lit(1)).alias("terms"), F.sum("n").alias("n"))


@register("query_terms_single_tenant", f"SELECT source_id, term, n FROM wf WHERE source_type = 'query' AND source_id % 3 = 0", "wf")
def query_terms_single_tenant(spark, sf):
    """Terms of questions are indexed only where their scope is one tenant."""
    asked = c.term_sources(spark, sf).filter("source_type = 'query'")
    scope = F.when(F.col("source_id") % 3 == 0, F.array("tenant")).otherwise(F.array("tenant", (F.col("tenant") + 1) % 5))
    return topics.word_frequencies(asked.withColumn("scope", scope).filter(F.size("scope") == 1)).select("source_id", "term", "n")


@register("unexpired_rows", f"SELECT id FROM qs WHERE created_at + INTERVAL 900 SECOND > TIMESTAMP '2024-01-15'", "qs")
def unexpired_rows(spark, sf):
    rows = c.queries(spark, sf).withColumn("expires_at", F.col("created_at") + F.expr("INTERVAL '900' SECOND"))
    return changes.unexpired(rows, k.stuck_before()).select("id")


# filters


@register("array_contains_filter", "SELECT id FROM qs WHERE list_contains(scope, 2)", "qs")
def array_contains_filter(spark, sf):
    return c.queries(spark, sf).filter(F.array_contains("scope", F.lit(2).cast("long"))).select("id")


@register("template_visibility", f"SELECT id FROM (SELECT id, CASE WHEN id % 6 = 0 THEN []::BIGINT[] ELSE scope END AS s FROM qs) WHERE len(s) = 0 OR list_has_any(s, {SCOPE}::BIGINT[])", "qs")
def template_visibility(spark, sf):
    """A template without tenants is everyone's."""
    rows = c.queries(spark, sf).select("id", F.when(F.col("id") % 6 == 0, F.array().cast("array<bigint>")).otherwise(F.col("scope")).alias("tenants"))
    return listing.visible_templates(rows, SCOPE).select("id")


@register("optional_filters", "SELECT id FROM qs WHERE status = 'answered' AND is_parliamentary", "qs")
def optional_filters(spark, sf):
    return listing.filtered(c.queries(spark, sf), status="answered", review_status=None, is_parliamentary=True, asked_by=None).select("id")


@register("audit_own_rows", "SELECT id, action FROM logs WHERE user_id = 7", "logs")
def audit_own_rows(spark, sf):
    return listing.visible_logs(c.audit_logs(spark, sf), 7, SCOPE, asked_user=7).select("id", "action")


@register("audit_tenant_recheck", "SELECT id FROM logs WHERE (tenant IN (0, 1, 3) OR user_id = 7) AND tenant = 3", "logs")
def audit_tenant_recheck(spark, sf):
    """Own rows of other tenants come with the visible ones; the asked tenant is checked again."""
    return listing.visible_logs(c.audit_logs(spark, sf), 7, SCOPE).filter(F.col("tenant") == 3).select("id")


@register("presented_queries", "SELECT id, status, coalesce(citation_count, 0) AS citations, coalesce(discarded, 0) AS discarded, review_status = 'pending' AS pending FROM qs", "qs")
def presented_queries(spark, sf):
    zero = lambda name: F.coalesce(name, F.lit(0).cast("long"))
    return c.queries(spark, sf).select("id", "status", zero("citation_count").alias("citations"), zero("discarded").alias("discarded"), (F.col("review_status") == "pending").alias("pending"))


SEARCHED = ["europe", "pdf", "validated"]


@register("search_documents", f"SELECT id, len(list_filter({SEARCHED}, lambda t: list_contains(w, t)))::BIGINT AS score FROM (SELECT id, [lower(code), type, status] AS w FROM docs JOIN subs USING (tenant)) WHERE list_has_any(w, {SEARCHED})", "docs", "subs")
def search_documents(spark, sf):
    """Any of the terms in a document's name and tags; the score counts those found."""
    docs = c.documents(spark, sf).join(c.subsidiaries(spark, sf), "tenant").select("id", F.concat_ws(" ", "code", "type", "status").alias("text"))
    return listing.text_search(docs, "id", {"text": 1}, " ".join(SEARCHED))


QA_SQL = f"""SELECT conv_id * 1000 + turn AS id, {c.tokens_sql('text')} AS q, coalesce({c.tokens_sql("lead(text) OVER (PARTITION BY conv_id ORDER BY turn)")}, []) AS a, role FROM conversations"""


@register("search_questions", f"""SELECT id, score FROM (SELECT id, (10 * len(list_filter(q, lambda x: x IN ('data', 'can', 'give', 'der', 'les'))) + 3 * len(list_filter(a, lambda x: x IN ('data', 'can', 'give', 'der', 'les'))))::BIGINT AS score
 FROM ({QA_SQL}) WHERE role = 'user') WHERE score > 0""")  # fmt: skip
def search_questions(spark, sf):
    """Terms of the question weigh 10, those of its answer 3."""
    turns = c.read(spark, sf, "conversations").withColumn("answer", F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))).filter("role = 'user'")
    rows = turns.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("text").alias("question"), "answer")
    return listing.text_search(rows, "id", {"question": 10, "answer": 3}, "data can give der les")


# joins and checks


@register("requested_documents_check", "SELECT o_custkey AS report_id, count(DISTINCT o_orderkey) = count(DISTINCT o_orderkey) FILTER (WHERE status = 'validated') AS usable, count(DISTINCT o_orderkey) AS asked FROM orders JOIN docs ON id = o_orderkey GROUP BY 1", "docs")
def requested_documents_check(spark, sf):
    """A report's documents, asked for twice or once: as many distinct ones have to be validated as were asked for."""
    asked = c.read(spark, sf, "orders").select(F.col("o_custkey").alias("report_id"), F.explode(F.array("o_orderkey", "o_orderkey")).alias("document_id"))
    return rules.all_usable(asked, c.documents(spark, sf).select(F.col("id").alias("document_id"), "status"))


@register("scope_exists", "SELECT id, count(s.tenant) = count(*) AS known FROM (SELECT id, unnest(scope) AS t FROM qs) LEFT JOIN (SELECT tenant FROM subs WHERE tenant < 4) s ON s.tenant = t GROUP BY 1", "qs", "subs")
def scope_exists(spark, sf):
    there = c.subsidiaries(spark, sf).filter("tenant < 4").select("tenant")
    return rules.all_known(c.queries(spark, sf).select("id", "scope"), there)


@register("chunk_report_in_scope", f"SELECT document_id, count(*) AS chunks FROM chunks WHERE document_id IN (SELECT id FROM reps WHERE tenant IN {SCOPE_SQL}) GROUP BY 1", "chunks", "reps")
def chunk_report_in_scope(spark, sf):
    linked = c.reports(spark, sf).filter(tenant_in(F.col("tenant"), SCOPE)).select(F.col("id").alias("document_id"))
    return c.chunks(spark, sf).join(linked, "document_id", "left_semi").groupBy("document_id").agg(F.count(F.lit(1)).alias("chunks"))


# analytics


@register("extraction_facets", f"""SELECT bucket, tenant, array_to_string(list_filter([CASE WHEN grouping(bucket) = 0 THEN 'bucket' END, CASE WHEN grouping(tenant) = 0 THEN 'tenant' END], lambda x: x IS NOT NULL), '+') AS facet, {FIELD_SQL}
 FROM (SELECT *, {quarter('created_at')} AS bucket FROM fields) GROUP BY GROUPING SETS ((bucket), (tenant), ())""", "fields")  # fmt: skip
def extraction_facets(spark, sf):
    return analytics.facets(c.fields(spark, sf), "created_at", "quarter", [["bucket"], ["tenant"], []], analytics.extraction_measures())


@register("reports_facets", f"""SELECT bucket, tenant, array_to_string(list_filter([CASE WHEN grouping(bucket) = 0 THEN 'bucket' END, CASE WHEN grouping(tenant) = 0 THEN 'tenant' END], lambda x: x IS NOT NULL), '+') AS facet, {REPORT_SQL}
 FROM (SELECT *, {quarter('published_at')} AS bucket FROM reps WHERE status IN ('published','archived')) GROUP BY GROUPING SETS ((bucket), (tenant), ())""", "reps")  # fmt: skip
def reports_facets(spark, sf):
    rows = c.reports(spark, sf).filter(F.col("status").isin("published", "archived"))
    return analytics.facets(rows, "published_at", "quarter", [["bucket"], ["tenant"], []], analytics.report_measures())


@register("queries_facets", f"""SELECT bucket, CASE WHEN grouping(bucket) = 0 THEN 'bucket' ELSE '' END AS facet, {QUERY_SQL} FROM (SELECT *, {month('created_at')} AS bucket FROM qs WHERE {CONTAINED_SQL}) GROUP BY GROUPING SETS ((bucket), ())""", "qs")
def queries_facets(spark, sf):
    rows = c.queries(spark, sf).filter(contained(F.col("scope"), SCOPE))
    return analytics.facets(rows, "created_at", "month", [["bucket"], []], analytics.query_measures())


@register("citation_coverage", f"SELECT bucket, {r('w * 100.0::DOUBLE / nullif(a, 0)')} AS coverage FROM (SELECT {month('created_at')} AS bucket, {count_if('status = $$answered$$ AND citation_count > 0', 'w')}, {count_if('status = $$answered$$', 'a')} FROM qs GROUP BY 1)", "qs")
def citation_coverage(spark, sf):
    rows = analytics.series(c.queries(spark, sf), "created_at", "month", analytics.query_measures())
    return rows.select("bucket", metrics.share(F.col("with_citations"), F.col("answered")).alias("coverage"))


@register("dashboard_metrics", f"""SELECT coalesce({r("(total_fields - overridden_fields)::DOUBLE / nullif(total_fields, 0) * 100.0")}, 0.0::DOUBLE) AS accuracy, coalesce(greatest(0.0::DOUBLE, {r("(validated - corrected_documents - awaiting_review)::DOUBLE / nullif(validated, 0) * 100.0")}), 0.0::DOUBLE) AS automation,
 coalesce({r("greatest(0.0, (validated * 45.0::DOUBLE - overridden_fields * 3.0) / nullif(validated * 45.0::DOUBLE, 0) * 100.0)")}, 0.0::DOUBLE) AS time_saved FROM (SELECT {DOC_SQL} FROM docs WHERE tenant IN {SCOPE_SQL}), (SELECT {FIELD_SQL} FROM fields WHERE tenant IN {SCOPE_SQL})""", "docs", "fields")  # fmt: skip
def dashboard_metrics(spark, sf):
    """A snapshot shows 0 where a ratio has no denominator."""
    mine = tenant_in(F.col("tenant"), SCOPE)
    whole = analytics.cross_section_totals(c.documents(spark, sf).filter(mine), c.fields(spark, sf).filter(mine))
    return whole.select(*[F.coalesce(x, F.lit(0.0)).alias(x) for x in ("accuracy", "automation", "time_saved")])


@register("section_points", f"SELECT bucket, measure, value FROM (SELECT {quarter('created_at')} AS bucket, {DOC_SQL} FROM docs GROUP BY 1) UNPIVOT (value FOR measure IN (total, validated, failed))", "docs")
def section_points(spark, sf):
    """A section's measures as points of a chart."""
    return analytics.series(c.documents(spark, sf), "created_at", "quarter", analytics.document_measures()).unpivot("bucket", ["total", "validated", "failed"], "measure", "value")


@register("fiscal_year_to_date", "SELECT count(*) AS n, ceil(epoch(TIMESTAMP '2024-02-01 00:00:00.001' - TIMESTAMP '2023-03-31 18:30:00') / 86400.0)::BIGINT AS days, max(ceil(epoch(TIMESTAMP '2024-02-01 00:00:00.001' - created_at) / 86400.0)::BIGINT) AS oldest_days FROM qs WHERE created_at >= TIMESTAMP '2023-03-31 18:30:00' AND created_at < TIMESTAMP '2024-02-01 00:00:00.001'", "qs")
def fiscal_year_to_date(spark, sf):
    """The default range, its ceiling in days, and the span in days of the oldest question in it."""
    bounds = calendar.checked_range(calendar.fiscal_year_to_date(datetime.fromisoformat(NOW)), "month")
    rows = c.queries(spark, sf).filter(calendar.within(F.col("created_at"), bounds))
    oldest = F.max(calendar.span_days_of(F.col("created_at"), F.lit(bounds[1]).cast("timestamp_ntz"))).alias("oldest_days")
    return rows.agg(F.count(F.lit(1)).alias("n"), oldest).withColumn("days", F.lit(calendar.span_days(*bounds)).cast("long"))


@register("real_dates", "SELECT id, d, try_cast(d AS DATE) IS NOT NULL AS is_date FROM (SELECT id, '2025-02-' || lpad((id % 40)::VARCHAR, 2, '0') AS d FROM docs)", "docs")
def real_dates(spark, sf):
    rows = c.documents(spark, sf).select("id", F.concat(F.lit("2025-02-"), F.lpad((F.col("id") % 40).cast("string"), 2, "0")).alias("d"))
    return rows.withColumn("is_date", calendar.is_real_date(F.col("d")))


# orders


@register("series_in_order", f"SELECT bucket, row_number() OVER (ORDER BY bucket) AS place, n FROM (SELECT {quarter('created_at')} AS bucket, count(*) AS n FROM docs GROUP BY 1)", "docs")
def series_in_order(spark, sf):
    """Keys of buckets sort by time as text."""
    rows = analytics.series(c.documents(spark, sf), "created_at", "quarter", {"n": F.count(F.lit(1))})
    return rows.withColumn("place", F.row_number().over(Window.orderBy("bucket")).cast("long"))  # a row for each bucket


VERSIONS_SQL = "SELECT document_id AS report_id, l_linenumber::BIGINT * 1000000000 + l_partkey * 100 + l_quantity::BIGINT AS version FROM fields"


@register("report_version_history", f"SELECT report_id, array_to_string(list_reverse_sort(list(version)), ',') AS versions, count(*) AS n FROM ({VERSIONS_SQL}) GROUP BY 1", "fields")
def report_version_history(spark, sf):
    versions = c.fields(spark, sf).select(F.col("document_id").alias("report_id"), k.field_version().alias("version"))
    return reports.history(versions).select("report_id", F.array_join(F.col("versions").cast("array<string>"), ",").alias("versions"), F.size("versions").cast("long").alias("n"))


@register("chunks_in_order", "SELECT document_id, chunk_id, row_number() OVER (PARTITION BY document_id ORDER BY chunk_index) AS place FROM chunks", "chunks")
def chunks_in_order(spark, sf):
    return c.chunks(spark, sf).select("document_id", "chunk_id", F.row_number().over(Window.partitionBy("document_id").orderBy("chunk_index")).cast("long").alias("place"))


@register("tenants_by_metric", f"SELECT tenant, m, row_number() OVER (ORDER BY coalesce(m, -1) DESC, tenant) AS place FROM (SELECT tenant, {r('count(*) FILTER (WHERE requires_review AND tenant <> 2) * 100.0::DOUBLE / nullif(count(*) FILTER (WHERE tenant <> 2), 0)')} AS m FROM docs GROUP BY 1)", "docs")
def tenants_by_metric(spark, sf):
    """Tenants by a ratio; one without it comes last, as -1."""
    asked = F.col("tenant") != 2
    rows = c.documents(spark, sf).groupBy("tenant").agg(metrics.share(analytics.count_if(F.col("requires_review") & asked), analytics.count_if(asked)).alias("m"))
    return rows.withColumn("place", F.row_number().over(Window.orderBy(F.coalesce("m", F.lit(-1.0)).desc(), "tenant")).cast("long"))  # a row for each tenant


@register("plotted_terms", f"SELECT term, frequency FROM ({k.CLOUD_SQL}) ORDER BY frequency DESC, term LIMIT 5", "wf")
def plotted_terms(spark, sf):
    return k.cloud(spark, sf)[1].orderBy(F.desc("frequency"), "term").limit(5).select("term", "frequency")


@register("unreviewed_on_page", "SELECT count(*) FILTER (WHERE has_unreviewed_figures) AS n FROM (SELECT * FROM reps WHERE status = 'published' ORDER BY published_at DESC, id DESC LIMIT 20 OFFSET 40)", "reps")
def unreviewed_on_page(spark, sf):
    page = listing.offset_page(listing.filtered(c.reports(spark, sf), status="published"), [F.col("published_at").desc(), F.col("id").desc()], 3, 20)
    return page.agg(analytics.count_if(F.col("has_unreviewed_figures")).cast("long").alias("n"))


# text


WIDE = {"Ａ": "a", "ｃ": "c", "ｅ": "e", "ｏ": "o", "ｒ": "r", "ｔ": "t"}
NORMAL_SQL = f"regexp_replace(translate(text, '{''.join(WIDE)}', '{''.join(WIDE.values())}'), '\\x{{200B}}', '', 'g')"


@register("tokens_normalised", f"SELECT item_id AS question_id, array_to_string({c.tokens_sql(NORMAL_SQL)}, ' ') AS terms FROM (SELECT item_id, replace(replace(replace(text, 'e', 'ｅ'), 'r', 'ｒ'), 't', chr(8203) || 'ｔ') AS text FROM benchmark)")
def tokens_normalised(spark, sf):
    """Full-width letters and characters that are seen by nobody make no other terms."""
    wide = F.replace(F.replace(F.replace("text", F.lit("e"), F.lit("ｅ")), F.lit("r"), F.lit("ｒ")), F.lit("t"), F.lit("​ｔ"))
    return c.questions(spark, sf).select("question_id", F.array_join(text.tokens(wide), " ").alias("terms"))


@register("bounded_texts", "SELECT item_id AS question_id, length(trim(text)) BETWEEN 3 AND 300 AS accepted, length(trim(text)) AS n FROM benchmark")
def bounded_texts(spark, sf):
    safe = text.safe(F.col("text"), 3, 300)
    return c.questions(spark, sf).select("question_id", safe.isNotNull().alias("accepted"), F.length(F.trim("text")).cast("long").alias("n"))


@register("previews", "SELECT doc_id, text[1:200] AS preview, text[1:300] AS quote FROM documents")
def previews(spark, sf):
    return c.read(spark, sf, "documents").select("doc_id", F.left("text", F.lit(200)).alias("preview"), F.left("text", F.lit(300)).alias("quote"))


@register("stripped_texts", "SELECT doc_id, regexp_replace(regexp_replace(chr(7) || ' ' || text || chr(0 + 11) || ' ', '[\\x01-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]', '', 'g'), '^\\s+|\\s+$', '', 'g') AS text FROM documents")
def stripped_texts(spark, sf):
    rows = c.read(spark, sf, "documents")
    return rows.select("doc_id", text.stripped(F.concat(F.lit("\x07 "), F.col("text"), F.lit("\x0b "))).alias("text"))


@register("colour_steps", "SELECT type, least(6, floor(n::DOUBLE / max(n) OVER () * 7))::BIGINT AS step FROM (SELECT type, count(*) AS n FROM docs GROUP BY 1)", "docs")
def colour_steps(spark, sf):
    counts = c.documents(spark, sf).groupBy("type").agg(F.count(F.lit(1)).alias("n"))
    share = F.col("n") / F.max("n").over(Window.partitionBy(F.lit(0)))  # a row for each type
    return counts.select("type", F.least(F.lit(6).cast("long"), F.floor(share * 7)).alias("step"))


# documents, queries, reports


@register("upload_manifest", "SELECT doc_id, (doc_id % 5)::VARCHAR || '/2026/04/' || doc_id::VARCHAR || '.txt' AS storage_key, sha256(text) AS checksum, octet_length(encode(text)) AS size_bytes, 'spreadsheet' AS type, 'queued' AS status FROM documents WHERE text <> ''")
def upload_manifest(spark, sf):
    """Text files through the gate: those accepted (an empty one isn't) are queued, with a key by tenant and month."""
    i = F.col("doc_id")
    files = c.read(spark, sf, "documents").select(i, (i % 5).alias("tenant"), F.concat(i.cast("string"), F.lit(".txt")).alias("path"), F.lit("text/plain").alias("mime"), F.col("text").cast("binary").alias("content"))
    return ingest.manifest(files, "2026/04").select("doc_id", "storage_key", "checksum", "size_bytes", "type", "status")


@register("text_gate_refuses", "SELECT page_id, page_id % 5 IN (0, 3) AS accepted FROM pages")
def text_gate_refuses(spark, sf):
    """Of five kinds of files, those with a NUL, a declared type that differs, or an unknown extension are refused."""
    kind = F.col("page_id") % 5
    path = F.when(kind == 2, "page.exe").when(kind == 3, "page.pdf").otherwise("page.txt")
    mime = F.when(kind == 4, "image/png").when(kind == 3, "application/pdf").otherwise("text/plain")
    head = F.when(kind == 1, "a\0b").when(kind == 3, "%PDF-1.7 ").otherwise("")
    files = c.read(spark, sf, "pages").select("page_id", path.alias("path"), mime.alias("mime"), F.concat(head, F.col("html")).cast("binary").alias("content"))
    return ingest.gated(files).select("page_id", "accepted")


PAGES_SQL = "SELECT doc_id AS document_id, p AS page, p * (p - 1) // 2 - CASE WHEN p % 3 = 0 THEN p - 1 ELSE 0 END AS first_line FROM documents, range(1, 60) r(p)"


def pages_of(spark, sf):
    """Pages of growing length, each third without a line."""
    docs = c.read(spark, sf, "documents").select(F.col("doc_id").alias("document_id"), F.explode(F.sequence(F.lit(1).cast("long"), F.lit(59).cast("long"))).alias("page"))
    p = F.col("page")
    return docs.withColumn("first_line", F.floor(p * (p - 1) / 2) - F.when(p % 3 == 0, p - 1).otherwise(0))


@register("chunk_pages", f"SELECT chunk_id, page FROM (SELECT chunk_id, page, row_number() OVER (PARTITION BY chunk_id ORDER BY first_line DESC, page DESC) AS k FROM chunks c JOIN ({PAGES_SQL}) p ON c.document_id = p.document_id AND p.first_line <= c.chunk_index) WHERE k = 1", "chunks")
def chunk_pages(spark, sf):
    """A chunk's page is that of its line, over given pages of uneven length."""
    return ingest.paged(c.chunks(spark, sf), pages_of(spark, sf), "chunk_index").select("chunk_id", "page")


@register("requeued_documents", "SELECT id, CASE WHEN status = 'processing' THEN 'queued' ELSE status END AS status FROM docs", "docs")
def requeued_documents(spark, sf):
    return changes.requeued(c.documents(spark, sf)).select("id", "status")


@register("override_fields", """SELECT document_id, l_linenumber::BIGINT AS line, CASE WHEN l_linenumber = 1 THEN 'corrected' ELSE l_partkey::VARCHAR END AS value, CASE WHEN l_linenumber = 1 THEN l_partkey::VARCHAR END AS original_value,
 CASE WHEN l_linenumber = 1 THEN 7 ELSE overridden_by END AS overridden_by, CASE WHEN l_linenumber = 1 THEN 'typing error' WHEN overridden_by IS NOT NULL THEN 'reason of ' || overridden_by::VARCHAR END AS override_reason FROM fields""", "fields")
def override_fields(spark, sf):
    """Corrected fields among others that have reasons of their own, which stay."""
    by = F.col("overridden_by").cast("long")
    rows = c.fields(spark, sf).select("document_id", F.col("l_linenumber").cast("long").alias("line"), F.col("l_partkey").cast("string").alias("value"), F.lit(None).cast("string").alias("original_value"), by, F.concat(F.lit("reason of "), by.cast("string")).alias("override_reason"))
    out = changes.overridden(rows, F.col("line") == 1, F.lit("corrected"), F.lit(7).cast("long"), F.lit("typing error"), F.lit(NOW).cast("timestamp_ntz"))
    return out.drop("overridden_at")


@register("asked_queries", "SELECT id, CASE WHEN len(scope) = 1 THEN scope[1] END AS tenant, CASE WHEN is_parliamentary THEN 'pending' ELSE 'not_required' END AS review_status, 'queued' AS status FROM qs WHERE len(scope) > 0", "qs")
def asked_queries(spark, sf):
    return rules.asked(c.queries(spark, sf).select("id", "scope", "is_parliamentary")).select("id", "tenant", "review_status", "status")


@register("review_rules", """SELECT id, CASE WHEN wanted = 'approved' AND asked_by % 3 <> 0 THEN 'forbidden' WHEN wanted IS NOT NULL AND status NOT IN ('answered','unsupported') THEN 'invalid_request' END AS refusal,
 CASE WHEN wanted IS NOT NULL AND status IN ('answered','unsupported') AND NOT (wanted = 'approved' AND asked_by % 3 <> 0) THEN wanted ELSE review_status END AS review_status, may_retry
 FROM (SELECT *, CASE WHEN id % 5 = 0 THEN 'approved' WHEN id % 5 = 1 THEN 'changes_requested' WHEN id % 5 = 2 THEN 'pending' END AS wanted, status = 'failed' AND id % 4 < 3 AND (asked_by = 7 OR asked_by % 10 = 0) AS may_retry FROM qs)""", "qs")
def review_rules(spark, sf):
    """Reviews, by an administrator where the asker's id divides by 3; retries are for the author or an administrator (here: askers whose id ends in 0), while attempts are left."""
    mine = (F.col("asked_by") == 7) | (F.col("asked_by") % 10 == 0)
    wanted = F.when(F.col("id") % 5 == 0, "approved").when(F.col("id") % 5 == 1, "changes_requested").when(F.col("id") % 5 == 2, "pending")
    rows = c.queries(spark, sf).withColumns({"reviewed_by": F.lit(None).cast("long"), "reviewed_at": F.lit(None).cast("timestamp_ntz"), "may_retry": changes.retryable(F.col("status"), F.col("id") % 4) & mine})
    return rules.reviewed(rows, wanted, F.lit(7).cast("long"), F.lit(NOW).cast("timestamp_ntz"), F.col("asked_by") % 3 == 0).select("id", "refusal", "review_status", "may_retry")


@register("report_transitions", "SELECT id, CASE WHEN status = 'published' THEN 'archived' WHEN status = 'draft' THEN 'archived' ELSE status END AS status, CASE WHEN status = 'draft' THEN 2 ELSE 1 END::BIGINT AS version FROM reps", "reps")
def report_transitions(spark, sf):
    """A changed draft gets its next version; then all that may be archived are."""
    rows = c.reports(spark, sf).select(F.col("id").alias("report_id"), "status").withColumn("version", F.lit(1).cast("long"))
    changed = reports.next_version(rows, rows.select("report_id")).select("report_id", F.col("version").alias("_new"))
    rows = rows.join(changed, "report_id", "left").withColumn("version", F.coalesce("_new", "version"))
    return reports.moved(rows, "archived").select(F.col("report_id").alias("id"), "status", "version")


@register("report_citations", """SELECT document_id AS report_id, unnest([0, 1, 2])::BIGINT AS place, unnest(['part', 'quantity', 'part']) AS key, max(l_linenumber::BIGINT * 1000000000 + l_partkey * 100 + l_quantity::BIGINT) AS field_id FROM fields GROUP BY 1""", "fields")
def report_citations(spark, sf):
    """One citation for each substitution, repeats kept."""
    rows = c.fields(spark, sf)
    named = F.explode(F.array(*[F.struct(F.lit(n).alias("field_name"), F.lit("x").alias("value")) for n in ("Part", "Quantity")]))
    fields = rows.select(F.col("document_id").alias("report_id"), k.field_version().alias("field_id"), "confidence", named.alias("f")).select("report_id", "field_id", "confidence", "f.*")
    templates = rows.select(F.col("document_id").alias("report_id")).distinct().withColumns({"section": F.lit(1), "body": F.lit("{{ Part }} of {{quantity}}, again {{part}} and {{ none }}")})
    return reports.citations(templates, fields).select("report_id", F.col("at").cast("long").alias("place"), "key", "field_id")


@register("unresolved_reports", "SELECT id AS report_id, NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = id AND l_linenumber = id % 7 + 1) AS unresolved FROM docs", "docs")
def unresolved_reports(spark, sf):
    """Each report asks for the quantity of one line, which its order may not have."""
    templates = c.documents(spark, sf).select(F.col("id").alias("report_id"), F.lit(1).alias("section"), F.concat(F.lit("Quantity: {{Line "), (F.col("id") % 7 + 1).cast("string"), F.lit("}}")).alias("body"))
    fields = c.fields(spark, sf).select(F.col("document_id").alias("report_id"), F.col("l_linenumber").alias("field_id"), F.concat(F.lit("line "), F.col("l_linenumber").cast("string")).alias("field_name"), F.col("l_quantity").cast("string").alias("value"), "confidence")
    return reports.drafted(templates, fields).select("report_id", reports.has_unresolved(F.col("text")).alias("unresolved"))


@register("rule_ids", f"SELECT document_id, array_to_string(list_sort(string_split(flags, ',')), ',') AS rules FROM ({k.FLAGS_SQL}) WHERE flags <> ''")
def rule_ids(spark, sf):
    return ingest.suspected_documents(k.with_planted(spark, sf).withColumn("text", text.folded(F.col("text")))).select("document_id", "rules")
