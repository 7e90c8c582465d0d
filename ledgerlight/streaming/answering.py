"""Questions as a stream: each is claimed, authorised anew, answered from retrieved passages, checked and stored.

A question's row goes queued -> retrieving -> answered, unsupported, failed or dead_lettered. Grants are those of the moment
of answering, not of asking. A question whose answer fails is failed and may be asked for again, and given up at its limit; one bad
question doesn't stop the others of its batch. A batch that runs again takes what it took before and counts no attempt more.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.calendar import month_key
from ..functions.text import answer_text, folded
from ..operators import index, ingest, retrieval, topics
from ..sources.kept import deleted
from .tables import append_once, audit_rows, replace_in, stored

ASKED = "query_id long, asked_by long, scope array<long>, document_ids array<long>, text string, is_parliamentary boolean, created_at timestamp_ntz, max_attempts int"
USERS = "user_id long, is_active boolean, role string, grants array<long>"
CITATION = "struct<ordinal: long, ref: string, chunk_id: long, document_id: long, tenant: long, quote: string>"
RESULT = (
    f"status string, answer_status string, failure_reason string, response_text string, citations array<{CITATION}>, candidates long, passages_used long, passages_withheld long, discarded long, injection_suspected boolean, rules array<string>"
)
STATE = f"{ASKED}, attempts int, {RESULT}, batch long, bucket int"
MOST_ATTEMPTS, MOST_CHARS = 3, 4000
# What a question's row says of how it ended.
REVOKED = "Access to the queried subsidiaries is no longer available"
RETRY, EXHAUSTED = "Answer generation failed; retry available", "Answer generation failed repeatedly; manual review required"
NOT_ENOUGH = "The authorised source material available to you does not contain enough information to answer this question."

Provider = Callable[[DataFrame, DataFrame], DataFrame]


def authorised(queries: DataFrame, users: DataFrame) -> DataFrame:
    """queries with `granted`: the asker is there, active, and an administrator or holds every tenant of the scope today."""
    who = users.select(F.col("user_id").alias("_user"), "is_active", "role", "grants")
    held = F.col("is_active") & ((F.col("role") == "admin") | (F.size(F.array_except("scope", F.coalesce("grants", F.array().cast("array<bigint>")))) == 0))
    return queries.join(who, queries["asked_by"] == F.col("_user"), "left").withColumn("granted", F.coalesce(held, F.lit(False))).drop("_user", "is_active", "role", "grants")


def extractive(questions: DataFrame, passages: DataFrame) -> DataFrame:
    """The library's own provider: the best sentences of the best passages, verbatim. It has no errors."""
    best = retrieval.bm25(questions, passages).select("question_id", "ref")
    chosen = retrieval.answer_sentences(questions, passages.join(best, ["question_id", "ref"]).withColumn("passage_order", F.col("rank").cast("long")))
    return retrieval.answers(questions, chosen, MOST_CHARS).select("question_id", "answer", "refs", F.lit(None).cast("string").alias("error"))


def by_python(answer: Callable[[str, list[dict], str], tuple[str, list[str]]]) -> Provider:
    """A provider of a function (question, passages of ref and text, style) to a text and the refs it claims, called once for each question.

    What it raises is that question's error: its kind, not its words.
    """

    def provider(questions: DataFrame, passages: DataFrame) -> DataFrame:
        held = passages.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("rank", "ref", "passage"))).alias("passages"))  # retrieval.TOP at most

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                rows = []
                for q, text, formal, found in zip(b["question_id"], b["text"], b["is_parliamentary"], b["passages"], strict=True):
                    try:
                        said, refs = answer(text, [{"ref": p["ref"], "text": p["passage"]} for p in found], "parliamentary" if formal else "standard")
                        rows.append((q, said, list(refs), None))
                    except Exception as error:
                        rows.append((q, None, [], type(error).__name__))
                yield pd.DataFrame(rows, columns=["question_id", "answer", "refs", "error"])

        return questions.join(held, "question_id").mapInPandas(run, "question_id long, answer string, refs array<string>, error string")

    return provider


def retrieved(spark: SparkSession, queries: DataFrame, folder: str, chunks: DataFrame, parents: DataFrame, keep: Callable[[DataFrame, str], DataFrame] = lambda rows, name: rows) -> tuple[DataFrame, DataFrame]:
    """The walk over each query's chunks (text, flags, kept, ref and more), and how many candidates each had.

    queries: query_id, text, scope, document_ids. Named documents narrow the search; a query whose words are found in none of them gets their first chunks.
    """
    asked = queries.select(F.col("query_id").alias("question_id"), "text", "scope", "document_ids")
    found = keep(index.candidates(spark, folder, asked, most=retrieval.CANDIDATES), "found")
    named = asked.select("question_id", "scope", F.explode(F.array_distinct("document_ids")).alias("document_id"))
    seen = lambda rows: rows.filter(F.array_contains("scope", F.col("tenant")))
    opening = seen(named.join(chunks.select("chunk_id", "document_id", "tenant", "chunk_index"), "document_id"))
    first = retrieval.fallback(asked.select("question_id"), found, opening.select("question_id", "document_id").distinct(), chunks.select("chunk_id", "document_id", "tenant", "chunk_index"))
    pool = keep(found.unionByName(first), "pool")
    considered = pool.groupBy("question_id").agg(F.count(F.lit(1)).alias("candidates"))
    checked = retrieval.verified(retrieval.capped(pool), parents)
    rows = checked.join(chunks.select("chunk_id", "text"), "chunk_id").withColumn("flags", ingest.injection_flags(folded(F.col("text"))))
    return retrieval.top_references(rows, ingest.suspected(F.col("flags"))), considered


def processed(spark: SparkSession, queries: DataFrame, users: DataFrame, folder: str, chunks: DataFrame, parents: DataFrame, provider: Provider = extractive, keep: Callable[[DataFrame, str], DataFrame] | None = None) -> DataFrame:
    """Claimed queries (ASKED and attempts, this one counted) with the columns of RESULT.

    keep(rows, name) may write an intermediate table and give it back read, so that what follows doesn't make it again.
    """
    keep = keep or (lambda rows, name: rows)
    judged = authorised(queries, users)
    open_ = judged.filter("granted")
    walked, considered = retrieved(spark, open_, folder, chunks, parents, keep)
    walked = keep(walked, "walked")
    flagged = walked.groupBy("question_id").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("flags")))).alias("rules"))  # of CANDIDATES chunks at most
    passages = retrieval.passages(walked).select("question_id", "chunk_id", "document_id", "tenant", "rank", "ref", "text", "quote", "passage", "withheld")
    counts = walked.groupBy("question_id").agg(F.count("ref").alias("used"), F.sum(F.when(F.col("kept"), 0).otherwise(1)).alias("withheld"))
    asked = open_.select(F.col("query_id").alias("question_id"), "text", "is_parliamentary", "scope")
    supplied = asked.join(counts.filter("used > 0").select("question_id"), "question_id", "left_semi")
    said = keep(provider(supplied, passages), "answers")
    claims = said.filter("error is null").select("question_id", F.posexplode("refs").alias("place", "ref"))
    issued = passages.join(asked.select("question_id", "scope"), "question_id").filter(F.array_contains("scope", F.col("tenant"))).select("question_id", "ref", "chunk_id", "tenant")
    checked = keep(retrieval.validated_citations(claims, issued), "citations")
    quoted = checked.filter("ordinal is not null").join(passages.select("question_id", "ref", "document_id", "tenant", "quote"), ["question_id", "ref"])
    cited = quoted.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", "ref", "chunk_id", "document_id", "tenant", "quote"))).alias("citations"))  # MOST_CITATIONS at most
    lost = checked.groupBy("question_id").agg(F.count_if(F.col("ordinal").isNull()).alias("discarded"))

    def tell(name: str) -> Column:
        return F.coalesce(name, F.lit(0)).cast("long")

    rows = judged.withColumnRenamed("query_id", "question_id")
    for more in (said.select("question_id", "answer", "error", F.lit(True).alias("asked")), considered, counts, flagged, cited, lost):
        rows = rows.join(more, "question_id", "left")
    n = F.when(F.col("citations").isNull(), 0).otherwise(F.size("citations"))
    none = F.array().cast(f"array<{CITATION}>")
    exhausted = F.col("attempts") >= F.coalesce("max_attempts", F.lit(MOST_ATTEMPTS))
    ordinals = F.map_from_entries(F.transform(F.coalesce("citations", none), lambda x: F.struct(x["ref"], x["ordinal"])))
    broken = F.col("error").isNotNull()
    ended = F.col("granted") & ~broken  # with an answer, or with nothing to answer from
    text = F.when(F.col("asked"), answer_text(F.col("answer"), ordinals, MOST_CHARS)).otherwise(NOT_ENOUGH)
    return rows.select(
        F.col("question_id").alias("query_id"), *[c for c in queries.columns if c != "query_id"],
        F.when(~F.col("granted"), "failed").when(broken, F.when(exhausted, "dead_lettered").otherwise("failed")).when(n > 0, "answered").otherwise("unsupported").alias("status"),
        F.when(ended, F.when(n == 0, "unsupported").when(tell("discarded") > 0, "partially_sourced").otherwise("sourced")).alias("answer_status"),
        F.when(~F.col("granted"), REVOKED).when(broken, F.when(exhausted, EXHAUSTED).otherwise(RETRY)).alias("failure_reason"),
        F.when(ended, text).alias("response_text"), F.when(ended, F.coalesce("citations", none)).otherwise(none).alias("citations"),
        tell("candidates").alias("candidates"), tell("used").alias("passages_used"), tell("withheld").alias("passages_withheld"), tell("discarded").alias("discarded"),
        F.coalesce(F.size("rules") > 0, F.lit(False)).alias("injection_suspected"), F.coalesce("rules", F.array().cast("array<string>")).alias("rules"),
    )


def claimed(batch: DataFrame, held: DataFrame, number: int) -> DataFrame:
    """Queries of a batch that are to be answered, with their attempts, this one counted.

    A row of the batch is a new question, or, for one that is stored, a wish to try it again: taken where it's queued, or failed with attempts left.
    """
    old = held.join(batch.select("query_id"), "query_id", "left_semi")
    again = F.col("batch") == number
    fit = again | F.col("status").isin("queued", "retrieving") | ((F.col("status") == "failed") & (F.col("attempts") < F.coalesce("max_attempts", F.lit(MOST_ATTEMPTS))))
    names = [x.split()[0] for x in ASKED.split(", ")]
    retried = old.filter(fit).select(*names, F.when(again, F.col("attempts")).otherwise(F.col("attempts") + 1).cast("int").alias("attempts"))
    new = batch.join(held.select("query_id"), "query_id", "left_anti").filter(F.col("text").isNotNull() & (F.size("scope") > 0)).select(*names, F.lit(1).alias("attempts"))
    return retried.unionByName(new)


def answer_stream(
    spark: SparkSession, landing: str, out: str, checkpoint: str, users: Callable[[], DataFrame], corpus: Callable[[], tuple[str, DataFrame, DataFrame]], provider: Provider = extractive,
    after: Callable[[DataFrame], None] | None = None, name: str = "answering",
) -> StreamingQuery:
    """Questions (JSON lines of ASKED; a query_id alone asks again) that land in a folder, each batch into tables under `out`.

    users() and corpus() (an index's folder, chunks, parents) are read anew for each batch. `out`/queries holds the state, `out`/audit the trail, `out`/terms the
    terms of answered questions whose scope is one tenant. after: gets the tenants of questions that ended (to drop cached results, say).
    """
    rows = spark.readStream.schema(ASKED).json(landing)

    def batch(asked: DataFrame, number: int) -> None:
        session, work = asked.sparkSession, f"{checkpoint}/work/{name}-{number}"

        def keep(df: DataFrame, what: str) -> DataFrame:
            path = f"{work}/{what}"
            df.write.mode("overwrite").parquet(path)
            return session.read.schema(df.schema).parquet(path)

        asked = asked.filter("query_id is not null").dropDuplicates(["query_id"])
        taken = keep(claimed(asked, stored(session, f"{out}/queries", STATE), number), "taken")
        if not taken.limit(1).count():
            return
        own = [f for f in session.createDataFrame([], STATE).schema if f.name not in taken.columns and f.name not in ("status", "batch", "bucket")]
        flight = taken.select("*", F.lit("retrieving").alias("status"), *[F.lit(None).cast(f.dataType).alias(f.name) for f in own], F.lit(number).cast("long").alias("batch"))
        order = [x for x in session.createDataFrame([], STATE).columns if x != "bucket"]
        replace_in(f"{out}/queries", flight.select(*order), "query_id", taken)  # claimed: a killed run leaves it in flight, under its number
        done = keep(processed(session, taken, users(), *corpus(), provider, keep).withColumn("batch", F.lit(number).cast("long")), "done")
        replace_in(f"{out}/queries", done.select(*order), "query_id", done)
        one = F.when(F.size("scope") == 1, F.element_at("scope", 1))
        ended = done.filter("status in ('answered', 'unsupported')")
        sources = ended.filter(F.size("scope") == 1).select(F.lit("query").alias("source_type"), F.col("query_id").alias("source_id"), one.alias("tenant"), F.col("created_at").alias("source_created_at"), "text")
        replace_in(f"{out}/terms", topics.word_frequencies(sources), ["source_type", "source_id"], sources, "period_month", month_key(F.col("source_created_at")))
        at = F.lit(number).cast("timestamp").cast("timestamp_ntz")
        entries = lambda of, action, **facts: audit_rows(of, F.lit(action), "Query", F.col("query_id"), F.col("asked_by"), one, facts, at)
        broken = done.filter(F.col("failure_reason").isin(RETRY, EXHAUSTED))
        trail = entries(ended, "query.answered", answer_status=F.col("answer_status"), citations=F.size("citations"), discarded=F.col("discarded"), passages_used=F.col("passages_used"), passages_withheld=F.col("passages_withheld"))
        trail = trail.unionByName(entries(done.filter(F.col("failure_reason") == REVOKED), "query.scope_revoked", scope_size=F.size("scope")))
        trail = trail.unionByName(entries(done.filter("injection_suspected"), "query.injection_suspected", rules=F.array_join("rules", ","), withheld=F.col("passages_withheld")))
        trail = trail.unionByName(entries(ended.filter("discarded > 0"), "query.citation_discarded", discarded=F.col("discarded"), accepted=F.size("citations")))
        trail = trail.unionByName(entries(broken, "query.generation_failed", attempts=F.col("attempts"), dead_lettered=F.col("status") == "dead_lettered"))
        append_once(f"{out}/audit", trail, name, number)
        if after is not None:
            after(ended.select(F.explode("scope").alias("tenant")).distinct())
        deleted(session, work)

    return rows.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
