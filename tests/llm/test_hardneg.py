import math
from collections import defaultdict

import numpy as np
import pytest

from ledgerlight.llm import hardneg
from ledgerlight.llm.hardneg import hard_negatives, op11_negatives, planes, planes_of, sliced

SF = "/root/testdata/sf0.01"
SCHEMA = "id long, vec array<double>, label int"


def brute(rows, every=50):
    """(anchor, positive, rank, negative, scores) by the wording, products as whole numbers of any size."""
    nearest = lambda x: max(-(1 << 63), min((1 << 63) - 1, x))
    rows = [(i, [math.floor(256 * x) for x in v], label) for i, v, label in rows]
    out = set()
    for i, v, label in rows:
        if i % every:
            continue
        scored = sorted(((-nearest(sum(a * b for a, b in zip(v, w, strict=False))), j, other) for j, w, other in rows if j != i), key=lambda x: x[:2])
        for p, j, _ in [x for x in scored if x[2] == label][:5]:
            fit = [(n, k) for n, k, other in scored if other != label and 50 * -p <= 100 * -n <= 95 * -p][:3]
            out |= {(i, j, r + 1, k, -p, -n) for r, (n, k) in enumerate(fit)}
    return out


def got(df):
    rows = [tuple(r[c] for c in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_query_equals_brute_force(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    have = [(r["vec_id"], r["embedding"], (r["label"] + 1) % 10 if r["vec_id"] % 7 == 0 else r["label"]) for r in rows if r["label"] is not None and r["embedding"]]
    want = brute(have)
    assert want and got(op11_negatives(spark, SF)) == want


@pytest.mark.parametrize("blocks", [(64, 8, 16), (256, 4, 64)])
def test_blocks_chunks_and_hot_labels(spark, monkeypatch, blocks):
    chunk, anchors, most = blocks
    for name, value in (("CHUNK", chunk), ("ANCHORS", anchors), ("MOST_ANCHORS", most), ("LEAST_CANDIDATES", 50)):
        monkeypatch.setattr(hardneg, name, value)
    rng = np.random.default_rng(3)
    rows = [(i, (rng.standard_normal(12) * 0.3 + (i % 3) * 0.2).tolist(), 0 if i % 3 else int(rng.integers(0, 4))) for i in range(600)]
    rows += [(1000 + i, rows[1][1], i % 2) for i in range(200)]  # one vector under two labels: ties
    assert got(hard_negatives(spark.createDataFrame(rows, SCHEMA), lambda i: i % 20 == 0)) == brute(rows, 20)


@pytest.mark.parametrize("size", [1.0, 1e6, 3e9, 1e30])
def test_large_components(spark, size):
    rng = np.random.default_rng(5)
    rows = [(i, (rng.integers(-20, 20, 3 + i % 2) * size / 8 + size).tolist(), i % 3) for i in range(120)]
    want = brute(rows, 10)
    assert (want or size > 1e9) and got(hard_negatives(spark.createDataFrame(rows, SCHEMA), lambda i: i % 10 == 0)) == want


def test_odd_rows(spark):
    rng = np.random.default_rng(9)
    good = [(i, rng.standard_normal(4).tolist(), i % 2) for i in range(60)] + [(70, [0.0, 0.0], 1), (80, [-0.5, 0.0, 0.0], 0)]
    bad = [(200, None, 1), (250, [], 1), (300, [1.0, None], 0), (350, [float("nan")], 0), (400, [float("inf")], 0), (450, [1.0] * 4, None), (None, [1.0] * 4, 1)]
    rows = spark.createDataFrame([(*r, "x", 1, b"z") for r in good + good[:9] + bad], f"{SCHEMA}, planes string, a int, c binary")
    assert got(hard_negatives(rows, lambda i: i % 10 == 0)) == brute(good, 10)
    assert got(hard_negatives(spark.createDataFrame([], SCHEMA), lambda i: i % 10 == 0)) == set()
    assert got(hard_negatives(spark.createDataFrame(good[1:9], SCHEMA), lambda i: i % 10 == 0)) == set()
    twice = good + [(3, [9.0] * 4, 1), (20, [-9.0] * 4, 0)]
    least = defaultdict(lambda: (9, []))
    for i, v, label in twice:
        least[i] = min(least[i], (label, v))
    assert got(hard_negatives(spark.createDataFrame(twice, SCHEMA), lambda i: i % 10 == 0)) == brute([(i, v, label) for i, (label, v) in least.items()], 10)


def test_planes_are_the_numbers():
    rng = np.random.default_rng(1)
    for top in (0.0, 1.0, 7.9, 1000.0):
        bits = planes_of(top)
        rows = np.floor(rng.uniform(-top, top, (20, 13)))
        sets = planes(sliced(rows, bits), bits, 13, float)
        back = sum((-1 if k == 0 else 1) * 2 ** (bits - 1 - k) * p for k, p in enumerate(sets))
        assert (back == rows).all()
