"""The inverted index finds what a search over all texts finds, and reads no text; kept tables follow their input."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerlight.operators import index, retrieval
from ledgerlight.plans import catalogue
from ledgerlight.sources.kept import fingerprint, kept, kept_folder

SF = "/root/testdata/sf0.001"
CHUNKS = "chunk_id long, document_id long, tenant long, text string"
WORDS = [f"word{a}{b}" for a in "abcdefgh" for b in "abcdefgh"]


def corpus(spark, seed, n=300):
    rng = random.Random(seed)
    weights = [1 / (i + 1) for i in range(len(WORDS))]
    rows = [(i, i // 3, i // 3 % 4, " ".join(rng.choices(WORDS, weights, k=rng.randint(0, 60)))) for i in range(n)]
    return spark.createDataFrame(rows, CHUNKS)


def rows_of(df):
    return sorted(tuple(r) for r in df.select("question_id", "chunk_id", "document_id", "tenant", "score", "rank").collect())


def questions(spark, seed, n=12):
    rng = random.Random(seed)
    return spark.createDataFrame([(i, " ".join(rng.choices(WORDS, k=rng.randint(1, 9)))) for i in range(n)] + [(90, "nothing known"), (91, ""), (92, None)], "question_id long, text string")


@pytest.mark.parametrize(("seed", "most", "scope"), [(1, 5, None), (2, 40, [0, 2]), (3, 1, [1]), (4, 400, None), (5, 7, [])])
def test_equals_a_search_over_all_texts(spark, tmp_path, seed, most, scope):
    chunks, asked = corpus(spark, seed), questions(spark, seed)
    index.write_segment(str(tmp_path), chunks)
    assert rows_of(index.candidates(spark, str(tmp_path), asked, scope, most)) == rows_of(retrieval.candidates(asked, chunks, scope, most))


def test_scopes_and_named_documents_of_each_question(spark, tmp_path):
    chunks, asked = corpus(spark, 6), questions(spark, 6)
    index.write_segment(str(tmp_path), chunks)
    scopes = {0: [0], 1: [1, 3], 2: [], 3: None}
    named = {0: None, 1: [], 2: [1, 2, 3, 4, 50], 3: [7], 4: [9999]}
    rows = [(r["question_id"], r["text"], scopes[r["question_id"] % 4], named[r["question_id"] % 5]) for r in asked.collect()]
    got = rows_of(index.candidates(spark, str(tmp_path), spark.createDataFrame(rows, "question_id long, text string, scope array<long>, document_ids array<long>"), most=9))
    want = []
    for q, text, scope, docs in rows:
        mine = chunks.filter(F.col("document_id").isin(docs)) if docs else chunks
        want += rows_of(retrieval.candidates(spark.createDataFrame([(q, text)], "question_id long, text string"), mine, scope or [], 9))
    assert got == sorted(want)


def test_segments_replace_documents(spark, tmp_path):
    first, again, asked = corpus(spark, 7), corpus(spark, 8), questions(spark, 7)
    folder, new = str(tmp_path / "i"), str(tmp_path / "j")
    index.write_segment(folder, first.filter("document_id < 80"), 0)
    index.write_segment(folder, again.filter("document_id between 40 and 60"), 1)
    index.write_segment(folder, first.filter("document_id >= 80"), 2)
    index.write_segment(folder, first.filter("document_id >= 80"), 2)  # a batch that runs again
    index.forget(folder, spark.createDataFrame([(3,), (99,)], "document_id long"), 3)
    now = first.filter("document_id not between 40 and 60").unionByName(again.filter("document_id between 40 and 60")).filter("document_id not in (3, 99)")
    want = rows_of(retrieval.candidates(asked, now, None, 6))
    assert rows_of(index.candidates(spark, folder, asked, None, 6)) == want
    index.compacted(spark, folder, new)
    assert rows_of(index.candidates(spark, new, asked, None, 6)) == want


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_searches_and_topics_read_no_text(spark):
    catalogue.retrieval_candidates(spark, SF).count()  # makes the index
    for plan in (plan_of(catalogue.retrieval_candidates(spark, SF)), plan_of(catalogue.topic_comparison(spark, SF)), plan_of(catalogue.word_cloud(spark, SF))):
        assert "documents.parquet" not in plan and "conversations.parquet" not in plan
    assert "regexp_extract_all" not in plan_of(catalogue.topic_trend(spark, SF))


def test_a_range_of_months_reads_their_folders_alone(spark):
    df = catalogue.topic_trend_range(spark, SF)
    df.count()
    assert "PartitionFilters: [isnotnull(period_month" in plan_of(df)
    files = catalogue.terms(spark, SF).filter("period_month between '2025-04' and '2025-09'").select(F.input_file_name()).distinct().collect()
    assert {f[0].split("period_month=")[1][:7] for f in files} <= {f"2025-0{i}" for i in range(4, 10)}


def test_kept_tables_follow_their_input(spark, tmp_path):
    at, made = str(tmp_path / "in.parquet"), []

    def make():
        made.append(1)
        return spark.read.parquet(at).withColumn("month", F.lit("2025-01"))

    def get():
        return sorted(r["id"] for r in kept(spark, "test", [at], "1", make, "month", ["id"]).collect())

    spark.range(3).write.parquet(at)
    key = fingerprint(spark, [at], "1")
    assert get() == get() == [0, 1, 2] and fingerprint(spark, [at], "1") == key != fingerprint(spark, [at], "2")
    spark.range(5).write.mode("overwrite").parquet(at)
    assert get() == [0, 1, 2, 3, 4] and fingerprint(spark, [at], "1") != key
    written = []
    folder = lambda: kept_folder(spark, "once", [at], "1", lambda to: (written.append(to), spark.range(1).write.parquet(to)))
    assert folder() == folder() and len(written) == 1
