import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from ledgerlight.llm.sharding import RemainingTree, best_fit, op1_sharding, shard_documents

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string"


def check(rows, texts, shards=16):
    """Every document once, slots gapless, sizes and checksums right; returns the sizes of the shards."""
    by_shard = defaultdict(list)
    for r in rows:
        data = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(data) + 1, zlib.crc32(data), "bytes", None) and 0 <= r["shard"] < shards
        by_shard[r["shard"]].append(r)
    for rs in by_shard.values():
        assert sorted(r["slot"] for r in rs) == list(range(len(rs)))
    return {s: sum(r["size"] for r in rs) for s, rs in by_shard.items()}


def test_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    rows = op1_sharding(spark, SF).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(d["doc_id"] for d in docs)
    sizes = check(rows, {d["doc_id"]: d["text"] for d in docs})
    largest = max(r["size"] for r in rows)
    assert len(sizes) == 16 and max(sizes.values()) - min(sizes.values()) <= max(0.05 * max(sizes.values()), largest)
    shard_of = defaultdict(set)
    for r in rows:
        shard_of[{d["doc_id"]: d["text"] for d in docs}[r["doc_id"]]].add(r["shard"])
    assert all(len(s) == 1 for s in shard_of.values())


def test_a_group_larger_than_a_shard_is_split(spark):
    rows = [(i, "same text of a third of all") for i in range(400)] + [(i, f"own text number {i} " + "x" * (i % 90)) for i in range(400, 1000)]
    sizes = check(shard_documents(spark.createDataFrame(rows, SCHEMA), shards=16).collect(), dict(rows))
    assert len(sizes) == 16 and max(sizes.values()) <= 1.1 * min(sizes.values())


def test_odd_rows(spark):
    rows = [(0, None), (1, ""), (2, "é"), (3, "x" * 300_000), (4, None), (5, "é")]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("key", F.lit(1)).withColumn("shard", F.lit(2)).withColumn("size", F.lit(3))
    check(shard_documents(df, shards=4).collect(), dict(rows), 4)
    twice = shard_documents(df.unionByName(df), shards=1).collect()
    assert sorted(r["slot"] for r in twice) == list(range(12))
    assert shard_documents(spark.createDataFrame([(None, "a"), (None, None)], SCHEMA)).count() == 2
    assert shard_documents(df.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_best_fit_takes_the_tightest_bin(seed):
    rng = random.Random(seed)
    sizes = sorted((rng.randrange(1, 120) for _ in range(500)), reverse=True)
    room, want = [], []
    for s in sizes:
        fits = [(r, i) for i, r in enumerate(room) if r >= s]
        if fits:
            at = min(fits)[1]
        else:
            at = len(room)
            room.append(max(100, s))
        room[at] -= s
        want.append(at)
    assert best_fit(sizes, 100) == want and best_fit(sizes, 100, most=3) is None


def test_tree_stays_balanced():
    tree = RemainingTree()
    for i in range(5000):
        tree.add(i, i)
    depth = lambda n: 0 if n is None else 1 + max(depth(n[2]), depth(n[3]))
    assert depth(tree.root) < 60 and tree.take_tightest(2500) == (2500, 2500) and tree.take_tightest(2500) == (2501, 2501) and tree.take_tightest(5000) is None
