import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ledgerlight.llm.packing import LENGTH, WordCache, first_fit, op5_packing, pack, padded_to, public_encoder

SF = "/root/testdata/sf0.01"
PATH = public_tokenizers.path("word_bpe_49k.json")


def ids_of(texts):
    return [np.array(e.ids + [1], "<u4") for e in Tokenizer.from_file(PATH).encode_batch([t or "" for t in texts], add_special_tokens=False)]


def check_pieces(rows, ids):
    """Every id of every document is in one piece; sequences are gapless and not too long."""
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append(r)
    assert by_doc.keys() == ids.keys()
    for d, pieces in by_doc.items():
        at = 0
        for p in sorted(pieces, key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(ids[d]) and p["length"] > 0
            at += p["length"]
            assert zlib.crc32(ids[d][p["start"] : at].tobytes()) == p["ids_crc32"]
        assert at == len(ids[d])
    for pieces in by_seq.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= LENGTH
    return by_seq


def test_query_round_trip(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    ids = dict(zip([d["doc_id"] for d in docs], ids_of([d["text"] for d in docs]), strict=True))
    sequences = check_pieces(op5_packing(spark, SF).collect(), ids)
    used = [sum(p["length"] for p in s) for s in sequences.values()]
    assert sum(used) >= 0.97 * sum(padded_to(u) for u in used)


ODD = [(0, None), (1, ""), (2, "a <|endoftext|> b"), (3, "İstanbul ΣΑΣ ʻokina  x\u0085y\x1cz é é"), (4, "it's 'tis we'll...,,. a.b,c 1,2.3 _x_"), (5, "word " * 30_000), (6, "日本語 текст"), (7, "½ ²x ﬁ"),
       (8, "x.\n\n,y .,"), (9, "ÀÉ. Ñandú, ßtraße.")]


def test_odd_texts(spark):
    df = spark.createDataFrame(ODD, "doc_id long, text string").withColumn("ids", F.lit(1)).withColumn("group", F.lit(2))
    ids = dict(zip([i for i, _ in ODD], ids_of([t for _, t in ODD]), strict=True))
    rows = pack(df, public_encoder()).withColumn("ids_crc32", F.crc32("ids")).collect()
    check_pieces(rows, ids)
    twice = pack(df.unionByName(df), public_encoder()).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    assert {r["doc_id"]: r["n"] for r in twice} == {i: 2 * len(x) for i, x in ids.items()}
    assert pack(df.limit(0), public_encoder()).count() == 0


def test_other_vocabularies_are_used_whole():
    path = public_tokenizers.path("byte_bpe_50k.json")
    text = "Two  words, it's\n\nnew"
    assert np.frombuffer(WordCache(path).encode(text), "<u4").tolist() == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("seed", range(3))
def test_first_fit_is_first_fit(seed):
    rng = random.Random(seed)
    sizes = sorted((rng.randrange(1, 100) for _ in range(400)), reverse=True)
    room, want = [], []
    for s in sizes:
        b = next((i for i, r in enumerate(room) if r >= s), len(room))
        if b == len(room):
            room.append(100)
        want.append((b, 100 - room[b]))
        room[b] -= s
    assert list(zip(*first_fit(sizes, 100), strict=True)) == want


def test_no_sizes():
    assert first_fit([], 10) == ([], [])


def test_repeated_rows_and_long_texts_are_dealt_apart(spark, monkeypatch):
    from ledgerlight.llm import packing

    monkeypatch.setattr(packing, "GROUP_BYTES", 20_000)
    rows = [(None, "same text again")] * 900 + [(7, None)] * 200 + [(i, "word " * (i % 50 * 20)) for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    out = pack(df, public_encoder()).collect()
    assert len({r["sequence_id"] >> 32 for r in out if r["doc_id"] is None}) > 5
    n = {i: len(x) for i, x in enumerate(ids_of([t for _, t in rows]))}
    assert sum(r["length"] for r in out) == sum(n.values()) and sum(r["doc_id"] is None for r in out) == 900 and sum(r["doc_id"] == 7 for r in out) == 201
