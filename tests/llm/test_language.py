import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlight.llm.language import SCRIPT_SHARE, SWITCH, Model, identify, is_held_out, label_words, op6_language, script_of, train, viterbi, words_of

SF = "/root/testdata/sf0.01"
TRAIN = [("en", "the house and the garden are near the river where they went"), ("de", "das haus und der garten liegen nahe bei dem fluss wohin sie gingen"),
         ("ru", "дом и сад находятся рядом с рекой куда они ходили")] * 30


@pytest.fixture(scope="module")
def model(spark):
    return train(spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate(TRAIN)] + [(-1, None, "en"), (-2, "x", None)], "doc_id long, text string, lang string"))


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()
    out = {r["doc_id"]: r for r in op6_language(spark, SF).collect()}
    assert len(out) == len(docs)
    held = [d for d in docs if zlib.crc32(str(d["doc_id"]).encode()) % 4 == 2]
    assert {i for i, r in out.items() if r["held_out"]} == {d["doc_id"] for d in held}
    assert sum(out[d["doc_id"]]["lang_pred"] == d["lang"] for d in held) >= 0.98 * len(held)
    assert all(0 <= r["score"] <= 1 for r in out.values())


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(4)
    scores = rng.normal(size=(5, 6, 3)) * 3
    lengths = np.array([6, 6, 4, 2, 1])
    labels = viterbi(scores.astype(np.float32), lengths, 2.0)
    for row, n in enumerate(lengths):
        value = lambda path: sum(scores[row, i, s] for i, s in enumerate(path)) - 2 * sum(a != b for a, b in itertools.pairwise(path))  # noqa: B023, E731
        best = max(itertools.product(range(3), repeat=int(n)), key=value)
        assert labels[row, :n].tolist() == list(best) and (labels[row, n:] == -1).all()


def test_spans_of_mixed_text(spark, model):
    text = "the house and the garden near the river " * 3 + "das haus und der garten nahe bei dem fluss " * 3 + "дом и сад рядом с рекой"
    row = identify(spark.createDataFrame([(1, text)], "doc_id long, text string"), model).first()
    assert [s["lang"] for s in row["spans"]] == ["en", "de", "ru"] and row["lang_pred"] in ("en", "de")


def test_script_narrows(model):
    labels, _ = label_words(model, ["щщщщ жжж"])[0]
    assert {model.languages[i] for i in labels} == {"ru"}
    assert script_of("a") != script_of("ж") != script_of("漢")


def test_odd_texts(spark, model):
    rows = [(0, None), (1, ""), (2, "12 34 !?"), (3, "the"), (4, "漢字"), (5, "the garden " * 50_000), (None, "das haus"), (3, "the")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("spans", F.lit(1)).withColumn("score", F.lit(9))
    out = identify(df, model).collect()
    assert len(out) == len(rows)
    by = {(r["doc_id"], r["text"]): r for r in out}
    assert [by[r]["lang_pred"] for r in rows[:4]] == ["und", "und", "und", "en"] and by[rows[0]]["score"] == 0
    assert by[rows[4]]["lang_pred"] in model.languages and by[rows[5]]["lang_pred"] == "en" and by[rows[6]]["lang_pred"] == "de"
    assert identify(df.limit(0), model).count() == 0
    assert train(spark.createDataFrame([], "doc_id long, text string, lang string")) is None
    assert {r["lang_pred"] for r in identify(df, None).collect()} == {"und"}
    assert [r[0] for r in spark.createDataFrame([(0,), (2,), (None,)], "doc_id long").select(is_held_out(F.col("doc_id"))).collect()] == [zlib.crc32(b"0") % 4 == 2, zlib.crc32(b"2") % 4 == 2, False]


def test_words_are_scored_once():
    m = Model(["a"], {}, np.zeros((1, 1), np.float32), np.ones((13, 1), bool))
    assert m.numbers(["x", "y", "x"]) == [0, 1, 0]


def brute(training, text):
    """Language and score of a text by the model's definition, in plain Python."""
    words = lambda t: [w for r in re.findall(r"[^\W\d_]+", t.lower()) for w in split(r)]

    def split(run):
        out = []
        for ch in run:
            if out and len(out[-1]) < 64 and script_of(out[-1][0]) == script_of(ch):
                out[-1] += ch
            else:
                out.append(ch)
        return out

    def grams(w):
        p = f"<{w}>"
        return [p[i : i + n] for n in range(1, 5) for i in range(len(p) - n + 1) if n > 1 or p[i] not in "<>"]

    langs = sorted({lang for _, lang in training})
    counts, scripts = {x: Counter() for x in langs}, {x: Counter() for x in langs}
    for t, lang in training:
        for w in words(t):
            counts[lang].update(grams(w))
            scripts[lang][script_of(w[0])] += 1
    kinds = {g for c in counts.values() for g in c}
    whole = {x: sum(counts[x].values()) + 0.5 * (len(kinds) + 1) for x in langs}

    def score(w, lang):
        g = grams(w)
        logs = {x: sum(math.log((counts[x][i] + 0.5) / whole[x]) for i in g) for x in langs}
        may = {x: scripts[x][script_of(w[0])] >= SCRIPT_SHARE * max(1, sum(scripts[x].values())) for x in langs}
        if not any(may.values()):
            return 0.0
        return (logs[lang] - max(logs.values())) * min(1.0, 8 / len(g)) if may[lang] else -50.0

    seq = words(text or "")
    if not seq:
        return "und", 0.0
    best = {x: (score(seq[0], x), [x]) for x in langs}
    for w in seq[1:]:
        best = {x: max(((v - SWITCH * (p[-1] != x), p) for v, p in best.values()), key=lambda c: c[0]) for x in langs}
        best = {x: (v + score(w, x), [*p, x]) for x, (v, p) in best.items()}
    path = max(best.values(), key=lambda c: c[0])[1]
    letters = Counter()
    for w, x in zip(seq, path, strict=True):
        letters[x] += len(w)
    lang = max(langs, key=lambda x: letters[x])
    return lang, letters[lang] / sum(letters.values())


def test_predictions_equal_brute_force(spark):
    docs = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang").orderBy("doc_id").limit(70).collect()]
    training, asked = docs[:40], docs[40:]
    texts = [(i, t[:1500] if t else t) for i, t, _ in asked] + [(-1, "漢字 и дом the house"), (-2, "thehouse" * 40 + "дом" * 50), (-3, None)]
    model = train(spark.createDataFrame(training, "doc_id long, text string, lang string"))
    found = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in identify(spark.createDataFrame(texts, "doc_id long, text string"), model).collect()}
    for i, t in texts:
        lang, score = brute([(t, lang) for _, t, lang in training if t and lang], t)
        assert found[i][0] == lang and found[i][1] == pytest.approx(score, abs=1e-9), i


def test_many_languages(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    name = lambda i: f"x{i:03d}"
    word = lambda i, j: letters[i % 26] * 2 + letters[i // 26] + letters[(i * 7 + j) % 26] + letters[i % 26]
    rows = [(i, " ".join(word(i, j) for j in range(12)), name(i)) for i in range(140)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {r["doc_id"]: r["lang_pred"] for r in identify(df, train(df)).collect()} == {i: name(i) for i in range(140)}


def test_long_runs_and_scripts_are_cut():
    assert words_of("Abc" * 50 + "дом漢字 x") == [("abc" * 50)[:64], ("abc" * 50)[64:128], ("abc" * 50)[128:], "дом", "漢字", "x"]
    assert words_of("naïve µm") == ["naïve", "µ", "m"]


def test_a_rare_language_is_learned(spark, monkeypatch):
    from ledgerlight.llm import language

    monkeypatch.setattr(language, "SAMPLE_DOCS", 20)
    rows = [(i, "the house and the garden", "en") for i in range(3000)] + [(5000 + i, "talo ja puutarha ovat joen luona", "fi") for i in range(3)]
    model = train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.languages == ["en", "fi"]
