import math
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from ledgerlight.llm import mixing
from ledgerlight.llm.mixing import copied, mix, op3_mixing, targets

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, source string, text string"


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def check(rows, docs, near):
    """docs: id to (source, text). Sizes, targets and bounds hold; each source is within near(target) of its target."""
    size, taken, want = defaultdict(int), defaultdict(int), {}
    for s, t in docs.values():
        size[s] += words(t)
    want = targets(size)
    for r in rows:
        s, t = docs[r["doc_id"]]
        assert r["size"] == words(t) and r["source_size"] == size[s] and r["target"] == pytest.approx(want[s]) and 0 <= r["taken"] <= 3 * r["size"] and (not r["size"] or r["taken"] % r["size"] == 0)
        taken[s] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= near(want[s]) for s in want)


def test_query(spark):
    docs = {r["doc_id"]: (r["source"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = op3_mixing(spark, SF).collect()
    assert len(rows) == len(docs)
    check(rows, docs, lambda t: 0.02 * t + 40)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, op3_mixing(spark, SF).collect()))


def test_targets_stop_at_three_times_the_size():
    assert targets({"a": 100, "b": 100, "c": 100}) == {"a": 50.0, "b": 100.0, "c": 150.0}
    got = targets({"a": 1000, "b": 1000, "c": 10, None: 40})
    assert got["c"] == 30.0 and sum(got.values()) == pytest.approx(2050) and all(v <= 3 * s for v, s in zip(got.values(), (1000, 1000, 10, 40), strict=True))
    assert list(targets({None: 5, "b": 5, "É": 5, "a": 5}))[:4] == ["a", "b", "É", None]
    assert targets({"a": 0, "b": 0}) == {"a": 0.0, "b": 0.0} and targets({}) == {}


def asked(df):
    return mix(df).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def test_hot_cells_and_sources(spark, monkeypatch):
    monkeypatch.setattr(mixing, "ROWS_PER_CELL", 10)
    docs = {i: ("big", "one two three four") for i in range(500)} | {500 + i: ("big", "w " * (1 + i % 60)) for i in range(200)}
    docs |= {800 + i: (s, "x " * (5 + i)) for i, s in enumerate(["m", "n", None, "tiny"] * 20)}
    check(asked(spark.createDataFrame([(i, *v) for i, v in docs.items()], SCHEMA)).collect(), docs, lambda t: 0.02 * t + 10)


def test_odd_rows(spark):
    docs = {0: (None, None), 1: ("a", ""), 2: ("a", " \t\n"), 3: ("b", "x " * 50_000), 4: ("b", "é ü"), 5: (None, "one"), 6: ("empty", None)}
    df = spark.createDataFrame([(i, *v) for i, v in docs.items()], SCHEMA).withColumn("size", F.lit("?")).withColumn("target", F.lit("?")).withColumn("n", F.lit(1)).withColumn("cell", F.lit(1))
    check(asked(df).collect(), docs, lambda t: 60_000)
    out = mix(df.unionByName(df))
    assert out.count() == 14 and out.groupBy("doc_id").agg(F.countDistinct("source_size").alias("n")).agg(F.max("n")).first()[0] == 1
    assert mix(df.limit(0)).count() == 0 and copied(mix(df.limit(0))).count() == 0
    assert mix(spark.createDataFrame([(None, "a", "x y")], SCHEMA)).count() == 1
    made = copied(mix(df))
    assert made.count() == mix(df).agg(F.sum("copies")).first()[0]


def rates(docs, want, most=3):
    """Rates that meet want (words of each source) by bisection, in plain Python: source and size to rate."""
    out = {}
    for s in {s for s, _ in docs}:
        zs = [z for x, z in docs if x == s and z]
        rate = lambda b, z: most / (1 + (most - 1) * math.exp(-max(-700.0, min(700.0, b * z))))
        low, high = -1e4, 1e4
        for _ in range(300):
            mid = (low + high) / 2
            low, high = (mid, high) if sum(rate(mid, z) * z for z in zs) < want[s] else (low, mid)
        out |= {(s, z): rate(low, z) for z in zs}
    return out


def test_rates_are_tilted_by_size(spark):
    """The dual's solution equals a bisection; copies of a size differ from it by what diffusion carries."""
    docs = {i: ("ab"[i % 2], "w " * (1 + i * i % 97)) for i in range(3000)}
    sizes = [(s, words(t)) for s, t in docs.values()]
    whole = {s: sum(z for x, z in sizes if x == s) for s in "ab"}
    want = rates(sizes, targets(whole))
    df = spark.createDataFrame([(i, *v) for i, v in docs.items()], SCHEMA)
    per = {(r["source"], r["size"]): (r["n"], r["c"]) for r in mix(df).groupBy("source", "size").agg(F.count(F.lit(1)).alias("n"), F.sum("copies").alias("c")).collect()}
    error = dict.fromkeys("ab", 0.0)
    for s, z in sorted(per, key=lambda k: -k[1]):
        n, c = per[s, z]
        error[s] += want[s, z] * n * z
        assert c == min(max(math.floor(error[s] / z + 0.5), 0), 3 * n) or abs(error[s] / z - c) < 0.5 + 1e-3
        error[s] -= c * z
    tilted = [want["b", z] for s, z in sorted(per) if s == "b"]
    assert tilted[0] < tilted[-1] and max(abs(e) for e in error.values()) <= 1


def test_extreme_sizes_and_many_sources(spark):
    docs = {0: ("long", "x " * 200_000)} | {i: ("long", "y " * (i % 7 + 1)) for i in range(1, 100)} | {1000 + i: (f"s{i:03d}", "z " * (i + 1)) for i in range(200)}
    check(asked(spark.createDataFrame([(i, *v) for i, v in docs.items()], SCHEMA)).collect(), docs, lambda t: max(0.02 * t + 120, 0.3 * t if t > 100_000 else 0))
