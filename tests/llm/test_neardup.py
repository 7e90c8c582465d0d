import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlight.llm import neardup
from ledgerlight.llm.neardup import HASHES, near_duplicates, op9_neardup, plan
from ledgerlight.llm.shingles import shingle_sets

SF = "/root/testdata/sf0.01"


def sets_of(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1)) if len(words) >= k else frozenset([tuple(words)])


def brute(rows, k, share):
    sets = [(i, sets_of(t, k)) for i, t in rows]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, (i, a) in enumerate(sets):
        for j, b in sets[n + 1 :]:
            if a and b and min(len(a), len(b)) * 100 >= share * max(len(a), len(b)):
                both = len(a & b)
                if 100 * both >= share * (len(a) + len(b) - both):
                    x, y = find(i), find(j)
                    root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i), find(i) == i) for i, s in sets}


def have(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in df.collect()}


def test_query_equals_brute_force(spark):
    rows = [(r[0], r[1]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert have(op9_neardup(spark, SF)) == brute(rows, 3, 85)


def chain(n, seed=4):
    """Texts of which each is near the next, and few others."""
    rng = random.Random(seed)
    words = [f"w{rng.randrange(5000)}" for _ in range(120)]
    out = []
    for _ in range(n):
        words = list(words)
        for _ in range(2):
            words[rng.randrange(len(words))] = f"w{rng.randrange(5000)}"
        out.append(" ".join(words))
    return out


def test_chains_and_borderline_groups(spark, monkeypatch):
    monkeypatch.setattr(neardup, "SIGNATURES", 5)
    monkeypatch.setattr(neardup, "TEXTS", 6)
    rng = random.Random(9)
    texts = chain(120) + chain(60, 5)
    base = [f"v{rng.randrange(900)}" for _ in range(150)]
    for _ in range(80):  # variants of one text, pairs of which are near the threshold
        words = list(base)
        for _ in range(rng.randrange(1, 6)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(words))
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    for k, s in ((3, 0.85), (5, 0.8)):
        assert have(near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k=k, similarity=s)) == brute(rows, k, round(100 * s))


def test_odd_rows(spark):
    rows = [(0, None), (1, ""), (2, " \t\n"), (3, "one two"), (4, "ONE  two"), (5, "one two three"), (6, "one two three"), (7, None), (8, "É one two"),
            (9, "é one two"), (10, "x" * 200_000), (11, "x" * 200_000), (12, "a b c " * 60_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit(1)).withColumn("key", F.lit("k"))
    assert have(near_duplicates(df, k=3, similarity=0.85)) == brute(rows, 3, 85)
    twice = near_duplicates(df.unionByName(df), k=3, similarity=0.85)
    assert twice.count() == 26 and have(twice) == brute(rows, 3, 85)
    unknown = spark.createDataFrame([(None, "one two three"), (5, "one two three"), (None, "lone words here")], "doc_id long, text string")
    assert sorted((r["component_id"] or -1, r["kept"]) for r in near_duplicates(unknown, k=3).collect()) == [(-1, False), (5, False), (5, True)]
    assert near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("similarity", [0.8, 0.85, 0.95])
def test_keys_cover_the_distance(similarity):
    distance, keys = plan(similarity)
    rng = np.random.default_rng(1)
    for _ in range(300):
        wrong = set(rng.choice(HASHES, distance, replace=False).tolist())
        assert any(not wrong & set(k) for k in keys)


def test_shingle_sets_match_words():
    texts = ["The quick\x0bBROWN fox", "the Quick brown fox", "", "a", "A", "a b", "the quick brown fox the quick brown fox", "x\x1cy z w"]
    hashed = [frozenset(s.tolist()) for s in shingle_sets([t.encode() for t in texts], 3)]
    plain = [sets_of(t, 3) for t in texts]
    for i in range(len(texts)):
        for j in range(len(texts)):
            assert len(hashed[i] & hashed[j]) == len(plain[i] & plain[j])


def test_hot_family_of_near_copies_is_not_crossed(spark, monkeypatch):
    monkeypatch.setattr(neardup, "SIGNATURES", 20)
    monkeypatch.setattr(neardup, "TEXTS", 20)
    rng = random.Random(12)
    base = [f"v{rng.randrange(900)}" for _ in range(200)]
    texts = []
    for _ in range(300):
        words = list(base)
        words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(words))
    rows = list(enumerate(texts))
    dealt, whole = {"key": [], "family": []}, neardup._grouped

    def counted(cells, group, within):
        dealt[group].append((cells.count(), cells.select(group).distinct().count()))
        return whole(cells, group, within)

    monkeypatch.setattr(neardup, "_grouped", counted)
    assert have(near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k=5, similarity=0.8)) == brute(rows, 5, 80)
    (first, families), (second, _) = dealt["family"]
    assert families == 1 and first <= 300 + 300 / 20 and second == 0
    assert sum(n for n, _ in dealt["key"][1:]) == 0
