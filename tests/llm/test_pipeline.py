import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerlight.llm.common import written
from ledgerlight.llm.mixing import targets

from .test_neardup import brute as brute_near
from .test_packing import ids_of
from .test_whole_job import brute_lines

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        made = written(stage(spark, docs, SF), "test-pipeline")
        out.append((docs, made))
        docs = made
    return out


def ids(df):
    return sorted(r[0] for r in df.select("doc_id").collect())


def rows(df):
    return [tuple(r) for r in df.select("doc_id", "text").collect()]


def test_columns(stages):
    for docs, made in stages[:-1]:
        assert made.schema.names == docs.schema.names == ["doc_id", "text", "lang", "source", "n_chars"]


def test_language_keeps_clean_documents(stages):
    docs, made = stages[0]
    clean = [i for i, t in rows(docs) if sum(c.isalpha() for c in t) > 0.5 * len(t) and len(t) > 100]
    assert len(set(clean) & set(ids(made))) >= 0.99 * len(clean)
    assert not set(ids(made)) - set(ids(docs))


def test_lines(stages):
    docs, made = stages[1]
    want = [(i, t) for i, _, gone, t in brute_lines(rows(docs)) if not gone or t.strip(" \t\n\x0b\x0c\r")]
    assert sorted(rows(made)) == sorted(want)
    assert made.filter((F.col("n_chars") != F.length("text")) & F.col("doc_id").isin([i for i, _, gone, _ in brute_lines(rows(docs)) if gone])).count() == 0


def test_one_of_each_group_stays(stages):
    docs, made = stages[2]
    assert ids(made) == sorted(i for i, (_, _, kept) in brute_near(rows(docs), 5, 80).items() if kept)


def test_mix_meets_targets(stages):
    docs, made = stages[3]
    words = lambda df: {r[0]: r[1] for r in df.groupBy("source").agg(F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")))).collect()}
    want, taken = targets(words(docs)), words(made)
    assert made.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 3
    for s, t in want.items():
        assert abs(taken.get(s, 0) - t) <= 0.02 * t + 60


def test_pack_holds_every_copy(stages):
    docs, made = stages[4]
    n = {i: len(x) for (i, _), x in zip(rows(docs), ids_of([t for _, t in rows(docs)]), strict=True)}
    copies = {r[0]: r[1] for r in docs.groupBy("doc_id").count().collect()}
    assert {r[0]: r[1] for r in made.groupBy("doc_id").agg(F.sum("length")).collect()} == {i: n[i] * c for i, c in copies.items()}


def test_odd_documents(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    odd = [(None, None, None, None, None), (1, None, "en", "a", 0), (2, "", None, "a", 0), (3, "12 34", "en", None, 5), (4, "the good words of the house", "en", None, 27),
           (4, "the good words of the house", "en", None, 27), (6, "the good words of the house", "en", "b", None), (7, "das haus und der garten", "de", "b", 3), (None, "the good words of the garden", "en", "c", 1)]
    for data in (odd, []):
        docs = spark.createDataFrame(data, schema)
        for _, stage in corpus_pipeline.STAGES:
            docs = written(stage(spark, docs, SF), "test-odd")
        assert (docs.count() > 0) == bool(data)


def test_run_twice_agrees(spark, stages):
    key = lambda df: sorted(tuple(r) for r in df.select("doc_id", "start", "length", "sequence_id", "offset", F.crc32("ids")).collect())
    assert key(corpus_pipeline.run(spark, SF)) == key(stages[-1][1])
