"""Extra columns with any name of the operators' own survive every function and stage; ids may repeat with other texts."""

import pytest

import corpus_pipeline
from ledgerlight.llm.language import identify, train
from ledgerlight.llm.lines import drop_recurring
from ledgerlight.llm.mixing import copied, mix
from ledgerlight.llm.pii import sanitise

NAMES = (
    "_id _key _new _k _base _added _label _size _src _order _spread _cell _rank _n _copies _whole _target _copy row n_lines n_dropped lang_pred score spans size source_size target copies key id found gone at"
    " template fixed leaf line words term node component _document _number kept n sig family"
).split()
WORDS = "the river ran past old mills while children watched boats drift slowly under stone bridges toward the distant sea"
RARE = "quiet gardens hold more secrets than loud markets ever could because nobody listens long enough to plants that grow"


def frame(spark):
    rows = [(1, f"{WORDS} one\n{RARE}", "en", "a"), (2, f"mail to ann@example.com about {RARE} and then some other words", "en", "b"), (3, None, None, None), (4, "", "en", "a"), (5, "①② ½", "de", "b"), (5, RARE, "en", "b"), (5, WORDS, "en", "a"), (5, WORDS, "en", "a")]
    out = [(i, t, lang, src, 0 if t is None else len(t), *[f"{c}-{k}" for c in NAMES]) for k, (i, t, lang, src) in enumerate(rows)]
    return spark.createDataFrame(out, "doc_id long, text string, lang string, source string, n_chars int, " + ", ".join(f"`{c}` string" for c in NAMES))


def extras(df, names=NAMES):
    return sorted(tuple(r[c] for c in ("doc_id", *names)) for r in df.select("doc_id", *[f"`{c}`" for c in names]).collect())


def test_operators(spark):
    docs = frame(spark)
    keeps = lambda *made: [c for c in NAMES if c.lower() not in made]
    own = ("n_lines", "n_dropped")
    assert extras(drop_recurring(docs.drop(*own)), keeps(*own)) == extras(docs, keeps(*own))
    assert extras(sanitise(docs.drop("spans")), keeps("spans")) == extras(docs, keeps("spans"))
    own = ("lang_pred", "score", "spans")
    assert extras(identify(docs.drop(*own), train(docs)), keeps(*own)) == extras(docs, keeps(*own))
    own = ("size", "source_size", "target", "copies")
    mixed = mix(docs.drop(*own))
    assert extras(mixed, keeps(*own)) == extras(docs, keeps(*own))
    assert set(extras(copied(mixed), keeps(*own))) <= set(extras(docs, keeps(*own)))


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES[:-1]])
def test_stages(spark, name):
    docs = frame(spark)
    out = dict(corpus_pipeline.STAGES)[name](spark, docs, "")
    assert out.columns == docs.columns
    have = {r["_id"]: r for r in docs.collect()}
    rows = out.collect()
    assert rows
    for r in rows:
        was = have[r["_id"]]
        assert [r[c] for c in NAMES] == [was[c] for c in NAMES] and r["doc_id"] == was["doc_id"]
        assert name == "lines" or r["text"] == was["text"]


def test_packing_reads_id_and_text_alone(spark):
    assert {r["doc_id"] for r in corpus_pipeline.packing_stage(spark, frame(spark), "").collect()} == {1, 2, 3, 4, 5}


def test_other_texts_of_a_removed_id_stay(spark):
    rows = [(3, WORDS), (5, RARE), (5, WORDS), (None, RARE + " x"), (None, "all its own words here and nowhere else to be seen at any time")]
    out = corpus_pipeline.near_duplicate_stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert sorted(map(tuple, out.collect()), key=str) == sorted([(3, WORDS), (5, RARE), rows[4]], key=str) or sorted(map(tuple, out.collect()), key=str) == sorted([(3, WORDS), rows[3], rows[4]], key=str)


def test_numerals_are_no_letters(spark):
    docs = spark.createDataFrame([(1, "das ist ein deutscher Satz", "de"), (2, "this is an English phrase", "en"), (3, "①② ½", "de"), (4, "123 ²", "de"), (5, "Ⅷ ௰ 12", "en"), (6, "das ist x²", None)], "doc_id long, text string, lang string")
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in identify(docs, train(docs.filter("doc_id < 3"))).collect()}
    assert got[3] == got[4] == got[5] == ("und", 0.0) and got[6][0] == "de"
