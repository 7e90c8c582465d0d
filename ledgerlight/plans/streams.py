"""Queries over what the streams and kept tables make: answered questions, their segments and citations, cached results, files and pages."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from ..functions import calendar, metrics
from ..functions.calendar import month_key
from ..operators import analytics, cache, ingest, retrieval, rollups
from ..sources import collections as c
from ..sources.files import files, texts
from ..sources.kept import kept_folder, work_folder, written
from ..streaming import answering
from . import catalogue as k
from .catalogue import DOC_SQL, FIELD_SQL, NOW, SCOPE, SCOPE_SQL, SUSPECT_SQL, quarter, register

# answering

#: Questions of the benchmark: asked by customers, over one or two tenants, one in seven about named documents.
ASKED_SQL = """q AS (SELECT item_id AS id, text, item_id * 7 % 150 + 1 AS asked_by, CASE WHEN item_id % 3 = 0 THEN [item_id % 5] ELSE [item_id % 5, (item_id + 1) % 5] END AS scope,
 CASE WHEN item_id % 7 = 0 THEN [item_id, item_id + 40] END AS named, item_id % 3 + 1 AS attempts, item_id % 10 = 9 AS breaks FROM benchmark),
users AS (SELECT c_custkey, c_acctbal >= 0 AS is_active, c_mktsegment = 'BUILDING' AS admin, [c_nationkey % 5, (c_nationkey + 1) % 5, (c_nationkey + 2) % 5] AS grants FROM customer),
g AS (SELECT q.*, coalesce(is_active AND (admin OR len(list_filter(scope, lambda x: NOT list_contains(grants, x))) = 0), false) AS granted FROM q LEFT JOIN users ON asked_by = c_custkey)"""


def asked(spark, sf):
    i = F.col("item_id")
    return c.read(spark, sf, "benchmark").select(
        i.alias("query_id"), (i * 7 % 150 + 1).alias("asked_by"), F.when(i % 3 == 0, F.array(i % 5)).otherwise(F.array(i % 5, (i + 1) % 5)).alias("scope"), F.when(i % 7 == 0, F.array(i, i + 40)).alias("document_ids"), "text",
        (i % 4 == 0).alias("is_parliamentary"), F.lit(k.NOW).cast("timestamp_ntz").alias("created_at"), F.lit(3).alias("max_attempts"), (i % 3 + 1).cast("int").alias("attempts"),
    )


def users(spark, sf):
    nation = F.col("c_nationkey").cast("long")
    role = F.when(F.col("c_mktsegment") == "BUILDING", "admin").otherwise("user")
    return c.read(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), (F.col("c_acctbal") >= 0).alias("is_active"), role.alias("role"), F.array(nation % 5, (nation + 1) % 5, (nation + 2) % 5).alias("grants"))


def claiming(questions, passages):
    """A provider that claims S1, S2 and S99 for every question, and breaks at each tenth."""
    broken = F.col("question_id") % 10 == 9
    return questions.select(
        "question_id", F.when(~broken, "See {{ref:S1}} and {{ref:S2}} but not {{ref:S99}}.").alias("answer"), F.when(broken, F.array().cast("array<string>")).otherwise(F.array(F.lit("S1"), F.lit("S2"), F.lit("S99"))).alias("refs"),
        F.when(broken, "TimeoutError").alias("error"),
    )


PROCESSED_SQL = f"""{ASKED_SQL},
terms AS ({k.ASKED_SQL}), words AS (SELECT chunk_id, document_id, tenant, unnest({c.tokens_sql('text')}) AS term FROM chunks),
cand AS (SELECT id, chunk_id, document_id, tenant, count(*) AS score FROM g JOIN terms ON g.id = terms.question_id JOIN words USING (term) WHERE granted AND list_contains(scope, tenant) AND (named IS NULL OR list_contains(named, document_id)) GROUP BY ALL),
pool AS (SELECT id, chunk_id, document_id, tenant, rank FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, chunk_id) AS rank FROM cand) WHERE rank <= 40 UNION ALL
 SELECT id, chunk_id, document_id, tenant, rank FROM (SELECT id, chunk_id, document_id, tenant, row_number() OVER (PARTITION BY id ORDER BY document_id, chunk_index) AS rank FROM
  (SELECT id, scope, unnest(named) AS document_id FROM g WHERE granted AND id NOT IN (SELECT id FROM cand)) JOIN chunks USING (document_id) WHERE list_contains(scope, tenant)) WHERE rank <= 40),
capped AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id, document_id ORDER BY rank) AS of_document FROM pool) WHERE of_document <= 2),
ver AS (SELECT capped.*, c.text FROM capped JOIN parents p ON capped.document_id = p.document_id AND capped.tenant = p.tenant JOIN (SELECT chunk_id, text FROM chunks) c USING (chunk_id) WHERE p.status = 'validated'),
walk AS (SELECT * FROM (SELECT *, coalesce(sum(kept::INT) OVER (PARTITION BY id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM (SELECT *, NOT {SUSPECT_SQL} AS kept FROM ver)) WHERE b < 8),
found AS (SELECT g.*, coalesce(p.n, 0) AS candidates, coalesce(w.used, 0)::BIGINT AS used, coalesce(w.withheld, 0)::BIGINT AS withheld FROM g LEFT JOIN (SELECT id, count(*) AS n FROM pool GROUP BY 1) p USING (id)
 LEFT JOIN (SELECT id, count(*) FILTER (WHERE kept) AS used, count(*) FILTER (WHERE NOT kept) AS withheld FROM walk GROUP BY 1) w USING (id)),
done AS (SELECT *, granted AND used > 0 AND breaks AS broken, CASE WHEN granted AND used > 0 AND NOT breaks THEN least(used, 2) ELSE 0 END AS n FROM found)
SELECT id AS query_id, CASE WHEN NOT granted THEN 'failed' WHEN broken THEN CASE WHEN attempts >= 3 THEN 'dead_lettered' ELSE 'failed' END WHEN n > 0 THEN 'answered' ELSE 'unsupported' END AS status,
 CASE WHEN granted AND NOT broken THEN CASE WHEN n = 0 THEN 'unsupported' ELSE 'partially_sourced' END END AS answer_status,
 CASE WHEN NOT granted THEN '{answering.REVOKED}' WHEN broken THEN CASE WHEN attempts >= 3 THEN '{answering.EXHAUSTED}' ELSE '{answering.RETRY}' END END AS failure_reason,
 CASE WHEN granted AND NOT broken THEN CASE WHEN n = 0 THEN '{answering.NOT_ENOUGH}' WHEN n = 1 THEN 'See [1] and but not .' ELSE 'See [1] and [2] but not .' END END AS response_text,
 n::BIGINT AS citations, candidates, used AS passages_used, withheld AS passages_withheld, CASE WHEN granted AND NOT broken AND used > 0 THEN 3 - n ELSE 0 END::BIGINT AS discarded FROM done"""


def done(spark, sf):
    return answering.processed(spark, asked(spark, sf), users(spark, sf), k.index_of(spark, sf), c.chunks(spark, sf), c.parents(spark, sf), claiming, written)


@register("processed_queries", PROCESSED_SQL, "chunks", "parents")
def processed_queries(spark, sf):
    """Claimed questions through authorisation, retrieval, answer, citations and their end."""
    return done(spark, sf).select("query_id", "status", "answer_status", "failure_reason", "response_text", F.size("citations").cast("long").alias("citations"), "candidates", "passages_used", "passages_withheld", "discarded")


@register("answer_segments", """SELECT question_id, (i - 1)::BIGINT AS place, p AS text, CASE WHEN o IN (1, 2) THEN o END AS ordinal, CASE WHEN o IN (1, 2) THEN question_id * 10 + o END AS chunk_id FROM (
 SELECT question_id, i, p, CASE WHEN p[1:1] = '[' THEN p[2:-2]::BIGINT END AS o FROM (SELECT question_id, unnest(range(1, len(ps) + 1)) AS i, unnest(ps) AS p FROM (
 SELECT item_id AS question_id, regexp_extract_all(replace(replace(text, '[', '('), ']', ')')[1:30] || '[1] and [3][2] then ' || replace(replace(text, '[', '('), ']', ')')[31:60] || '[12]', '\\[\\d{1,9}\\]|[^\\[]+') AS ps FROM benchmark)))""")
def answer_segments(spark, sf):
    """Answers cut at their markers, each with its citation; markers without one stay text."""
    plain = F.replace(F.replace("text", F.lit("["), F.lit("(")), F.lit("]"), F.lit(")"))
    answers = c.questions(spark, sf).select("question_id", F.concat(F.substring(plain, 1, 30), F.lit("[1] and [3][2] then "), F.substring(plain, 31, 30), F.lit("[12]")).alias("answer"))
    cited = c.questions(spark, sf).select("question_id", F.explode(F.array(F.lit(1), F.lit(2)).cast("array<bigint>")).alias("ordinal")).withColumn("chunk_id", F.col("question_id") * 10 + F.col("ordinal"))
    return retrieval.answer_segments(answers, cited)


@register("citations_readable", f"SELECT id, len(list_filter(scope, lambda t: t IN {SCOPE_SQL})) AS citations FROM qs WHERE len(list_filter(scope, lambda t: t IN {SCOPE_SQL})) > 0", "qs")
def citations_readable(spark, sf):
    """Stored citations, one for each tenant of a query's scope, as a reader of three tenants may see them."""
    held = c.queries(spark, sf).select("id", F.explode("scope").alias("tenant"))
    return retrieval.readable_citations(held, SCOPE).groupBy("id").agg(F.count(F.lit(1)).alias("citations"))


@register("retrieval_fallback_mixed", f"""WITH RECURSIVE none AS (SELECT 1), """ + c.with_ctes(f"""SELECT question_id, chunk_id, rank FROM ({k.CAND_SQL}) WHERE question_id % 4 <> 0 UNION ALL
 SELECT question_id, chunk_id, rank FROM (SELECT question_id, chunk_id, row_number() OVER (PARTITION BY question_id ORDER BY document_id, chunk_index) AS rank FROM (SELECT item_id AS question_id, unnest([item_id, item_id + 40]) AS document_id FROM benchmark WHERE item_id % 4 = 0) JOIN chunks USING (document_id)) WHERE rank <= 40""", "chunks").removeprefix("WITH "))
def retrieval_fallback_mixed(spark, sf):
    """Questions that find something and questions (each fourth has its words taken away) that get their named documents' first chunks, in one."""
    asked = c.questions(spark, sf)
    mixed = asked.withColumn("text", F.when(F.col("question_id") % 4 == 0, "?").otherwise(F.col("text")))
    pinned = asked.select("question_id", F.explode(F.array(F.col("question_id"), F.col("question_id") + 40)).alias("document_id"))
    found = written(k.index.candidates(spark, k.index_of(spark, sf), mixed, SCOPE), "mixed")
    return found.unionByName(retrieval.fallback(mixed, found, pinned, c.chunks(spark, sf))).select("question_id", "chunk_id", "rank")


# cached results


@register("cached_totals", f"SELECT {DOC_SQL} FROM docs WHERE tenant IN {SCOPE_SQL}", "docs")
def cached_totals(spark, sf):
    """Totals through the cache: stored, invalidated by one of their tenants, made again, and found."""
    at = datetime.fromisoformat(NOW)
    held = cache.ResultCache(spark, work_folder(spark, "results"))
    make = lambda: analytics.totals(c.documents(spark, sf).filter(F.col("tenant").isin(*SCOPE)), analytics.document_measures())
    get = lambda now: held.get("totals", 1, SCOPE, {"of": sf}, make, timedelta(minutes=5), now)
    get(at)
    held.invalidate([SCOPE[0]], at + timedelta(seconds=1))
    get(at + timedelta(seconds=2))
    return get(at + timedelta(seconds=3))


@register("cache_invalidated", f"SELECT id FROM qs WHERE created_at + INTERVAL 30 DAY > TIMESTAMP '{NOW}' AND len(CASE WHEN id % 10 = 0 THEN [] ELSE scope END) > 0 AND NOT list_has_any(scope, [2, 4]::BIGINT[])", "qs")
def cache_invalidated(spark, sf):
    """Entries that hold after two tenants' results were dropped: those over all tenants (an empty scope) fall too."""
    scope = F.when(F.col("id") % 10 == 0, F.array().cast("array<bigint>")).otherwise(F.col("scope"))
    entries = c.queries(spark, sf).select("id", scope.alias("scope"), (F.col("created_at") + F.expr("INTERVAL '30' DAY")).alias("expires_at"))
    return cache.surviving(entries, [2, 4], F.lit(NOW).cast("timestamp_ntz")).select("id")


# files


def files_of(spark, sf):
    """The benchmark's texts as files, a folder each, made once."""
    rows = c.read(spark, sf, "benchmark").withColumn("ending", F.when(F.col("item_id") % 4 == 3, "bin").otherwise("txt"))
    folder = kept_folder(spark, "files", [f"{sf}/benchmark.parquet"], "files-1", lambda to: rows.select("item_id", "text").repartitionByRange("item_id").write.partitionBy("item_id").text(to))
    return files(spark, folder, "part-*.txt").withColumn("item_id", F.regexp_extract("path", r"item_id=(\d+)", 1).cast("long"))


@register("files_ingested", "SELECT item_id, item_id % 4 <> 3 AS accepted, octet_length(encode(text)) + 1 AS size_bytes, sha256(text || chr(10)) AS checksum, CASE WHEN item_id % 4 <> 3 THEN length(text) + 1 END AS chars FROM benchmark")
def files_ingested(spark, sf):
    """Files from a folder through the gate (each fourth is declared what it isn't), with checksum and text."""
    found = files_of(spark, sf).withColumn("mime", F.when(F.col("item_id") % 4 == 3, "image/png").otherwise(F.col("mime")))
    gated = ingest.gated(found).withColumn("checksum", F.sha2("content", 256))
    return texts(gated).select("item_id", "accepted", "size_bytes", "checksum", F.when(F.col("accepted"), F.length("text")).cast("long").alias("chars"))


def paragraphs(piece: str):
    return [(f"line {i}", x) for i, x in enumerate(piece.split("\n")) if x.strip()]


@register("extracted_pieces", "SELECT doc_id, i - 1 AS line, piece FROM (SELECT doc_id, unnest(range(1, len(p) + 1)) AS i, unnest(p) AS piece FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents)) WHERE trim(piece, ' ') <> ''")
def extracted_pieces(spark, sf):
    """A pluggable extractor as a table function, joined laterally: one text in, its pieces out."""
    ingest.extractor("lines_of", paragraphs, spark)
    c.read(spark, sf, "documents").select("doc_id", "text").createOrReplaceTempView("extractor_documents")
    rows = spark.sql("SELECT d.doc_id, e.section, e.piece FROM extractor_documents d, LATERAL lines_of(d.text) e")
    return rows.select("doc_id", F.regexp_extract("section", r"\d+", 0).cast("long").alias("line"), "piece")


# rollups


def corrected(spark, sf):
    """Sums of fields by month and tenant, and the sets of corrected documents."""
    over = F.col("overridden_by").isNotNull()
    sums = {"total_fields": F.lit(1), "overridden_fields": over.cast("long"), "low_confidence": (F.col("confidence") <= metrics.LOW_CONFIDENCE).cast("long")}
    parts = lambda: rollups.rolled(c.fields(spark, sf), {"month": month_key(F.col("created_at")), "tenant": F.col("tenant")}, sums, F.when(over, F.col("document_id")))

    def write(to: str) -> None:
        of, sets = parts()
        of.write.parquet(f"{to}/sums")
        sets.write.parquet(f"{to}/sets")

    names = ("lineitem", "orders", "customer", "nation")
    folder = kept_folder(spark, "corrected", [f"{sf}/{n}.parquet" for n in names], rollups.VERSION, write)
    return spark.read.parquet(f"{folder}/sums"), spark.read.parquet(f"{folder}/sets"), list(sums)


def quarter_of(month):
    return calendar.quarter_key(F.to_timestamp_ntz(F.concat(month, F.lit("-15 00:00:00"))))


ROLLED_SQL = "total_fields, overridden_fields, low_confidence, corrected_documents"


@register("extraction_rollup_quarter", f"SELECT bucket, {ROLLED_SQL} FROM (SELECT {quarter('created_at')} AS bucket, {FIELD_SQL} FROM fields GROUP BY 1)", "fields")
def extraction_rollup_quarter(spark, sf):
    """Quarters from the months' rollup: no field is read, and the distinct count is exact."""
    of, sets, names = corrected(spark, sf)
    return rollups.merged(of, sets, {"bucket": quarter_of(F.col("month"))}, names, "corrected_documents")


@register("extraction_rollup_tenant", f"SELECT tenant, {ROLLED_SQL} FROM (SELECT tenant, {FIELD_SQL} FROM fields GROUP BY 1)", "fields")
def extraction_rollup_tenant(spark, sf):
    of, sets, names = corrected(spark, sf)
    return rollups.merged(of, sets, {"tenant": F.col("tenant")}, names, "corrected_documents")


@register("extraction_rollup_total", f"SELECT {ROLLED_SQL} FROM (SELECT {FIELD_SQL} FROM fields WHERE tenant IN {SCOPE_SQL})", "fields")
def extraction_rollup_total(spark, sf):
    of, sets, names = corrected(spark, sf)
    mine = F.col("tenant").isin(*SCOPE)
    return rollups.merged(of.filter(mine), sets.filter(mine), {}, names, "corrected_documents")
