import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlight.llm import suffix
from ledgerlight.llm.suffix import matching_statistics, op7_suffix, remove_repeats

SF = "/root/testdata/sf0.01"


def brute(rows, size):
    data = [(t or "").encode() for _, t in rows]
    starts = Counter(d[i : i + size] for d in data for i in range(len(d) - size + 1))
    out = []
    for (doc, _), d in zip(rows, data, strict=True):
        covered = np.zeros(len(d), bool)
        for i in range(len(d) - size + 1):
            if starts[d[i : i + size]] > 1:
                covered[i : i + size] = True
        runs = int((np.diff(np.concatenate([[0], covered.astype(int)])) == 1).sum())
        kept = bytes(np.frombuffer(d, np.uint8)[~covered])
        out.append((doc, len(d), int(covered.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def have(df):
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    rows = df.select("doc_id", "n_bytes", removed, F.size("spans"), F.sha2("kept", 256)).collect()
    return sorted((tuple(r) for r in rows), key=str)


def test_query_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted((tuple(r) for r in op7_suffix(spark, SF).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()), key=str)
    assert got == brute(rows, 200)


def planted(seed, alphabet="abcdé "):
    rng = random.Random(seed)
    word = lambda n: "".join(rng.choice(alphabet) for _ in range(n))
    passages = [word(rng.randrange(30, 200)) for _ in range(8)]
    rows = []
    for i in range(120):
        parts = [word(rng.randrange(0, 60))]
        for _ in range(rng.randrange(3)):
            p = rng.choice(passages)
            a, b = sorted(rng.randrange(len(p) + 1) for _ in range(2))
            parts += [p[a:b] if rng.random() < 0.5 else p, word(rng.randrange(0, 40))]
        rows.append((i, "".join(parts)))
    return rows


@pytest.mark.parametrize("hot", [10_000, 2])
@pytest.mark.parametrize("step", [1 << 20, 97])
def test_planted_passages(spark, monkeypatch, hot, step):
    monkeypatch.setattr(suffix, "STEP", step)
    monkeypatch.setattr(suffix, "INDEX_BYTES", 2000)
    rows = planted(hot + step)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert have(remove_repeats(df, size=40, gram=16, hot=hot)) == brute(rows, 40)


def test_odd_rows(spark):
    long = "".join(random.Random(1).choice("abcdef") for _ in range(3000))
    rows = [(0, None), (1, ""), (2, "short"), (3, "a" * 500), (4, "ab" * 400), (5, long), (6, "x" + long[100:900] + "y"), (7, None), (8, "short"), (9, "b" * 199), (10, "b" * 199), (None, "é" * 150)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit(1)).withColumn("start", F.lit(2))
    assert have(remove_repeats(df)) == brute(rows, 200)
    assert have(remove_repeats(df.unionByName(df))) == brute(rows + rows, 200)
    assert remove_repeats(df.limit(0)).count() == 0


def test_matching_statistics_equal_brute_force():
    rng = random.Random(6)
    for letters in ("ab", "abcd\x00"):
        segments = ["".join(rng.choice(letters) for _ in range(rng.randrange(20, 90))).encode() for _ in range(12)]
        segments += [segments[0][3:19], segments[1] + segments[2]]
        stats, first = matching_statistics(segments)
        where = [(s, i) for s, seg in enumerate(segments) for i in range(len(seg))]
        for s, i in where:
            best = 0
            for t, j in where:
                if (t, j) != (s, i):
                    n = 0
                    while i + n < len(segments[s]) and j + n < len(segments[t]) and segments[s][i + n] == segments[t][j + n]:
                        n += 1
                    best = max(best, n)
            assert stats[first[s] + i] == best
