"""Lexical retrieval within a scope, passage scoring, sentence selection and citations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import metrics
from ..functions.scope import tenant_in
from ..functions.text import MOST_SEARCH_TERMS, bigrams, dedup_key, escaped, normalised, sentences, tokens

CANDIDATES, PER_DOCUMENT, TOP, PASSAGES, SENTENCES = 40, 2, 8, 5, 3
K1, B, PHRASE, DECAY, FIGURE, LEAST = 1.2, 0.75, 0.5, 0.9, 0.25, 0.15
MOST_CITATIONS = 20


def candidates(questions: DataFrame, chunks: DataFrame, scope: Sequence[int] | None = None, most: int = CANDIDATES) -> DataFrame:
    """question_id, chunk columns, score, rank: the chunks that hold most of a question's distinct terms, ties by id.

    The score is the sum of the terms' counts in the chunk. The join is on the term; terms without
    a question are dropped where the chunk lies, and without any term asked no chunk is read.
    """
    asked = questions.select("question_id", F.explode(F.slice(F.array_distinct(tokens(F.col("text"))), 1, MOST_SEARCH_TERMS)).alias("term"))
    held = chunks.filter(tenant_in(F.col("tenant"), scope)).select("chunk_id", "document_id", "tenant", F.explode(tokens(F.col("text"))).alias("term"))
    held = held.join(asked.select("term").distinct(), "term", "left_semi")
    counted = held.groupBy("chunk_id", "document_id", "tenant", "term").agg(F.count(F.lit(1)).alias("n"))
    scored = asked.join(counted, "term").groupBy("question_id", "chunk_id", "document_id", "tenant").agg(F.sum("n").alias("score"))
    return ranked(scored, most)


def ranked(scored: DataFrame, most: int, by: str = "question_id") -> DataFrame:
    order = Window.partitionBy(by).orderBy(F.desc("score"), "chunk_id")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)


def fallback(questions: DataFrame, found: DataFrame, pinned: DataFrame, chunks: DataFrame, most: int = CANDIDATES) -> DataFrame:
    """For questions with named documents (question_id, document_id) and no match: the documents' first chunks."""
    without = questions.join(found, "question_id", "left_anti").select("question_id")
    rows = pinned.join(without, "question_id", "left_semi").join(chunks, "document_id")
    order = Window.partitionBy("question_id").orderBy("document_id", "chunk_index")
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most).select("question_id", "chunk_id", "document_id", "tenant", F.lit(0).cast("long").alias("score"), "rank")


def capped(found: DataFrame, most: int = PER_DOCUMENT) -> DataFrame:
    """No more than `most` chunks of a document for a question, the best ones."""
    order = Window.partitionBy("question_id", "document_id").orderBy("rank")
    return found.withColumn("_of_document", F.row_number().over(order)).filter(F.col("_of_document") <= most).drop("_of_document")


def verified(found: DataFrame, parents: DataFrame, scope: Sequence[int] | None = None) -> DataFrame:
    """Chunks whose document is validated, in scope, and of the chunk's own tenant; drift gives nothing, not a leak."""
    good = parents.filter((F.col("status") == "validated") & tenant_in(F.col("tenant"), scope)).select("document_id", "tenant")
    return found.join(good, ["document_id", "tenant"], "left_semi")


def top_references(found: DataFrame, blocked: Column, most: int = TOP) -> DataFrame:
    """Walk each question's chunks in order, withhold blocked ones, stop at `most` kept: rows seen, with ref S1.. where kept."""
    order = Window.partitionBy("question_id").orderBy("rank")
    rows = found.withColumn("kept", ~blocked)
    before = F.coalesce(F.sum(F.col("kept").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("_before", before).filter(F.col("_before") < most)
    return rows.withColumn("ref", F.when(F.col("kept"), F.concat(F.lit("S"), (F.col("_before") + 1).cast("string")))).drop("_before")


def passages(walked: DataFrame, quote: int = 300) -> DataFrame:
    """The kept rows of a walk (question_id, text, flags, kept, ref) with a quote and escaped passage, and for each question how many
    rows the walk withheld and how many kept ones have flags."""
    whole = Window.partitionBy("question_id")  # TOP kept rows, and at most CANDIDATES in all
    counts = {"withheld": F.sum(F.when(F.col("kept"), 0).otherwise(1)).over(whole), "retained_flagged": F.sum(F.when(F.col("kept") & (F.size("flags") > 0), 1).otherwise(0)).over(whole)}
    rows = walked.withColumns(counts).filter("kept")
    return rows.withColumns({"quote": F.left("text", F.lit(quote)), "passage": escaped(F.col("text"), "n0nce", 1200)})


def bm25(questions: DataFrame, passages: DataFrame, most: int = PASSAGES) -> DataFrame:
    """question_id, ref, bm25, place: passages (question_id, ref, text) by BM25 over the question's own passages.

    A passage that holds two neighbouring terms of the question side by side gets PHRASE more.
    """
    asked = questions.select("question_id", tokens(F.col("text")).alias("_t")).select("question_id", F.array_distinct("_t").alias("terms"), bigrams(F.col("_t")).alias("pairs"))
    held = passages.select("question_id", "ref", "text", tokens(F.col("text")).alias("tokens")).withColumn("length", F.size("tokens"))
    whole = Window.partitionBy("question_id")
    held = held.withColumns({"n": F.count(F.lit(1)).over(whole), "mean": F.avg("length").over(whole)})
    # all that follows is dealt by the question, as the passages are
    counts = F.transform("terms", lambda t: F.struct(t.alias("term"), F.size(F.filter("tokens", lambda x: x == t)).alias("tf")))
    phrase = F.exists("pairs", lambda p: F.contains(F.lower("text"), p))
    hits = held.join(asked, "question_id").select("question_id", "ref", "n", "mean", "length", phrase.alias("_p"), F.inline(counts))
    found = F.col("tf") > 0
    hits = hits.withColumn("df", F.count_if(found).over(Window.partitionBy("question_id", "term")))
    idf = F.ln(1.0 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * (F.col("tf") * (K1 + 1.0)) / (F.col("tf") + K1 * (1.0 - B + B * F.col("length") / F.col("mean")))
    sums = hits.groupBy("question_id", "ref").agg(F.sum(F.when(found, part)).alias("_s"), F.max("_p").alias("_p"))
    score = metrics.rounded(F.coalesce("_s", F.lit(0.0)) + F.when(F.col("_p"), PHRASE).otherwise(0.0), 6)
    order = Window.partitionBy("question_id").orderBy(F.desc("bm25"), "ref")
    return sums.select("question_id", "ref", score.alias("bm25")).filter("bm25 > 0").withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most)


def answer_sentences(questions: DataFrame, passages: DataFrame, most: int = SENTENCES) -> DataFrame:
    """question_id, ref, passage_order, sentence_index, sentence, score of the chosen sentences.

    passages: question_id, ref, passage_order, text. A sentence gets the share of the question's terms that it has,
    less for each sentence before it, and more for a figure.
    """
    asked = questions.select("question_id", tokens(F.col("text")).alias("terms"))
    each = passages.select("question_id", "ref", "passage_order", F.posexplode(sentences(F.col("text"))).alias("sentence_index", "sentence")).join(asked, "question_id")
    overlap = F.size(F.array_intersect("terms", tokens(F.col("sentence"))))
    score = metrics.rounded(overlap / F.greatest(F.size("terms"), F.lit(1)) * F.pow(F.lit(DECAY), F.col("sentence_index")) + F.when(F.rlike("sentence", F.lit(r"\d")), FIGURE).otherwise(0.0), 6)
    kept = each.filter(overlap > 0).withColumn("score", score).filter(F.col("score") >= LEAST)
    order = Window.partitionBy("question_id").orderBy(F.desc("score"), "passage_order", "sentence_index", "sentence")
    kept = kept.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= most)
    same = Window.partitionBy("question_id", dedup_key(F.col("sentence"))).orderBy("_rank")
    return kept.withColumn("_same", F.row_number().over(same)).filter("_same = 1").drop("_same", "_rank", "terms")


# The texts around an answer.
BASED, SOURCES = "Based on ", " source passage(s): "
NOTHING = "No authorised source in scope supports an answer to this question."
DRAFT_HEAD = "Draft response, assembled verbatim from authorised source material:"
DRAFT_FOOT = "Sources are cited separately. This draft requires human review and approval before use in an official response."


def answers(questions: DataFrame, chosen: DataFrame, most_chars: int = 4000) -> DataFrame:
    """question_id, answer, unsupported, refs: the chosen sentences in the passages' order, with their references.

    questions: question_id and, where there are such, is_parliamentary: those answers are a numbered draft for review.
    """
    parts = chosen.groupBy("question_id").agg(
        F.array_sort(F.collect_list(F.struct("passage_order", "sentence_index", "sentence", "ref"))).alias("parts")  # SENTENCES at most
    )
    cited = lambda p: F.concat(p["sentence"], F.lit(" {{ref:"), p["ref"], F.lit("}}"))
    refs = F.array_distinct(F.transform("parts", lambda p: p["ref"]))
    standard = F.concat(F.lit(BASED), F.size(refs).cast("string"), F.lit(SOURCES), F.array_join(F.transform("parts", cited), " "))
    numbered = F.array_join(F.transform("parts", lambda p, i: F.concat((i + 1).cast("string"), F.lit(". "), cited(p))), "\n")
    draft = F.concat(F.lit(f"{DRAFT_HEAD}\n\n"), numbered, F.lit(f"\n\n{DRAFT_FOOT}"))
    text = F.when(F.col("is_parliamentary"), draft).otherwise(standard) if "is_parliamentary" in questions.columns else standard
    none = F.col("parts").isNull()
    return questions.join(parts, "question_id", "left").select(
        "question_id", F.when(none, NOTHING).otherwise(F.left(text, F.lit(most_chars))).alias("answer"), none.alias("unsupported"), F.coalesce(refs, F.array().cast("array<string>")).alias("refs")
    )


def answer_segments(answers: DataFrame, citations: DataFrame) -> DataFrame:
    """answers (question_id, answer with [n] markers) to question_id, place, text, ordinal, chunk_id: pieces of text and of citations, in order.

    citations: question_id, ordinal, chunk_id. A marker whose ordinal has no citation stays as text of its own; empty pieces are left out.
    """
    words = F.split("answer", r"(?<=\[\d{1,9}\])|(?=\[\d{1,9}\])")
    pieces = answers.select("question_id", F.posexplode(F.filter(words, lambda x: x != "")).alias("place", "text"))
    pieces = pieces.withColumn("ordinal", F.when(F.rlike("text", F.lit(r"^\[\d{1,9}\]$")), F.regexp_extract("text", r"\d+", 0).cast("long")))
    return pieces.join(citations.select("question_id", "ordinal", "chunk_id"), ["question_id", "ordinal"], "left").select(
        "question_id", F.col("place").cast("long").alias("place"), "text", F.when(F.col("chunk_id").isNotNull(), F.col("ordinal")).alias("ordinal"), "chunk_id"
    )


def claimed_refs(text: Column) -> Column:
    """References that a text claims, in order."""
    return F.regexp_extract_all(text, F.lit(r"\{\{ref:(S\d{1,3})\}\}"), F.lit(1))


def prompts(questions: DataFrame, passages: DataFrame, nonce: str, fence: str = "GROUNDED_UNTRUSTED_SOURCE") -> DataFrame:
    """question_id, prompt: the question and its passages (ref, rank, text and, where there are such, page and section), each within a fence of its own.

    Nothing else goes in: no ids of documents, chunks, tenants or users. Texts and sections are escaped, so none can close its fence; a section is one line
    of 120 characters at most. A question without passages has its fence alone.
    """
    attribute = lambda name: F.trim(F.regexp_replace(escaped(F.col(name).cast("string"), nonce, 120, fence), "[\"\n\r]", " "))
    more = [F.when(F.col(n).isNotNull(), F.concat(F.lit(f' {n}="'), attribute(n), F.lit('"'))).otherwise("") for n in ("page", "section") if n in passages.columns]
    ref = F.concat(F.lit(' ref="'), F.col("ref"), F.lit('"'))
    held = F.concat(F.lit(f"<<<{fence} {nonce}"), ref, *more, F.lit(">>>\n"), escaped(F.col("text"), nonce, 1 << 20, fence), F.lit(f"\n<<<END {fence} {nonce}"), ref, F.lit(">>>"))
    each = passages.select("question_id", F.struct("rank", held.alias("block")).alias("one")).groupBy("question_id").agg(F.array_sort(F.collect_list("one")).alias("all"))  # TOP at most
    context = F.array_join(F.transform("all", lambda x: x["block"]), "\n\n")
    asked = F.concat(F.lit(f"<<<QUESTION {nonce}>>>\n"), normalised(F.col("text")), F.lit(f"\n<<<END QUESTION {nonce}>>>\n\n"), F.coalesce(context, F.lit("")))
    return questions.join(each, "question_id", "left").select("question_id", asked.alias("prompt"))


def readable_citations(citations: DataFrame, scope: Sequence[int] | None) -> DataFrame:
    """Stored citations (query_id, tenant and more) as this reader may see them now, whoever asked: those of other tenants are left out."""
    return citations.filter(tenant_in(F.col("tenant"), scope))


def validated_citations(claims: DataFrame, issued: DataFrame, scope: Sequence[int] | None = None, most: int = MOST_CITATIONS) -> DataFrame:
    """claims (question_id, ref, place) against issued (question_id, ref, chunk_id, tenant).

    Returns question_id, ref, chunk_id, ordinal (from 1; null where discarded). A claim that was never issued, or
    of a tenant beyond the scope, is discarded; a second one of the same chunk is left out, which is no discard.
    """
    first = claims.groupBy("question_id", "ref").agg(F.min("place").alias("place"))
    joined = first.join(issued, ["question_id", "ref"], "left")
    good = F.col("chunk_id").isNotNull() & tenant_in(F.col("tenant"), scope)
    rows = joined.withColumn("_good", F.coalesce(good, F.lit(False)))
    same = Window.partitionBy("question_id", "chunk_id", "_good").orderBy("place")
    rows = rows.withColumn("_same", F.row_number().over(same)).filter(~F.col("_good") | (F.col("_same") == 1))
    order = Window.partitionBy("question_id", "_good").orderBy("place")
    rows = rows.withColumn("_n", F.row_number().over(order)).filter(~F.col("_good") | (F.col("_n") <= most))
    return rows.select("question_id", "ref", F.when(F.col("_good"), F.col("chunk_id")).alias("chunk_id"), F.when(F.col("_good"), F.col("_n")).cast("long").alias("ordinal"))


def citation_status(checked: DataFrame, questions: DataFrame) -> DataFrame:
    counts = checked.groupBy("question_id").agg(F.count("ordinal").alias("accepted"), F.sum(F.when(F.col("ordinal").isNull(), 1).otherwise(0)).alias("discarded"))
    rows = questions.select("question_id").join(counts, "question_id", "left").fillna(0, ["accepted", "discarded"])
    return rows.withColumn("status", F.when(F.col("accepted") == 0, "unsupported").when(F.col("discarded") > 0, "partially_sourced").otherwise("sourced"))
