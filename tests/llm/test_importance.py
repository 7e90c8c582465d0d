import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from ledgerlight.llm import importance
from ledgerlight.llm.importance import features, gains, op12_importance, resample, sliced_words

SF = "/root/testdata/sf0.01"


def brute(docs, target):
    """Rows of the query by its wording."""

    def found(text):
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)
        runs = [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]
        return len(words), [zlib.crc32(x.encode()) % 10000 for x in runs]

    of = [found(t) for _, t in docs]
    s, t = Counter(b for _, x in of for b in x), Counter(b for x in target for b in found(x)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((float(t[b] + 1) * (all_s + 10000)) / (float(s[b] + 1) * (all_t + 10000)))) for b in range(10000)]
    rows, able = [], []
    for (i, _), (n, x) in zip(docs, of, strict=True):
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        w = sum(gain[b] for b in x)
        rows.append([i, len(x), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
        if n >= 20:
            able.append(rows[-1])
    able.sort(key=lambda r: (-r[3], r[0] is not None, r[0] or 0, r[1], r[2]))
    for k, r in enumerate(able[: 5 * len(able) // 100]):
        r[4] = k + 1
    return sorted(map(tuple, rows), key=str)


def rows_of(df):
    return sorted(map(tuple, df.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=str)


def test_query_equals_brute_force(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    target = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert rows_of(op12_importance(spark, SF)) == brute(docs, target)


@pytest.mark.parametrize("size", [1, 3, 7, 64])
def test_slices_lose_and_repeat_nothing(size, monkeypatch):
    monkeypatch.setattr(importance, "SLICE", size)
    for text in ("", " ", "one", "One two  three,four five-six seven", "a b c d e f g h", "longword " * 9 + "end", "é è_ü 1 2 3  "):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower())
        want = Counter(zlib.crc32(" ".join(words[i : i + n]).encode()) % 10000 for n in (1, 2, 3) for i in range(len(words) - n + 1))
        assert Counter(b for w, old in sliced_words(text.encode()) for x in features(w, old) for b in x.tolist()) == want


def test_odd_rows_ties_and_clashing_columns(spark, monkeypatch):
    monkeypatch.setattr(importance, "GATHERED", 50)  # sums in several goes
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega "
    docs = [(i, words + f"w{i % 7}") for i in range(60)] + [(7, words + "w0")] * 3 + [(100, None), (101, ""), (102, "!?"), (None, words), (103, "short one"), (104, words * 4000)]
    frame = spark.createDataFrame([(i, t, 1, "x", 2.0) for i, t in docs], "doc_id long, text string, weight int, able string, part double")
    target = spark.createDataFrame([("alpha beta gamma",), (None,), ("",)], "text string")
    assert rows_of(resample(frame, target)) == brute(docs, ["alpha beta gamma", None, ""])
    none = spark.createDataFrame([], "doc_id long, text string")
    assert resample(none, target).count() == 0
    assert rows_of(resample(frame, none)) == brute(docs, [])


def test_gains_of_empty_counts():
    assert gains(np.zeros(10000, np.int64), np.zeros(10000, np.int64)).tolist() == [0] * 10000
