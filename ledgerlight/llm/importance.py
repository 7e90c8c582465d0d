"""Resampling documents towards a target distribution by hashed n-grams, in two Arrow passes.

A feature is a run of 1 to 3 words; it falls into one of a fixed number of buckets by the crc32 of its
bytes. The first pass gives one vector of bucket counts for each partition (np.bincount), and treeReduce
merges the vectors, so the driver gets a few of fixed length however many partitions there are. From the
counts of the source and of the target each bucket has a gain, a fixed-point logarithm of how much likelier the
target is to hold it. The second pass gathers the broadcast gains of a batch's features and sums them for each document
by np.bincount with weights. A Gumbel number of each document's id turns the weight into a score whose highest values
are a draw without replacement in proportion to exp(weight / 1000).

Texts are read as bytes in slices that end between words, so a text of any length needs the memory of one slice.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import spread_table, table, written

BUCKETS = 10_000
#: Words of a feature, at most.
NGRAM = 3
#: Bytes of a text that are cut into words at a time, and features that a batch gathers before it sums them.
SLICE, GATHERED = 1 << 20, 1 << 19

#: Upper-case ASCII letters to lower case; ASCII other than letters and digits to a blank; bytes of other characters stay.
_WORD_BYTES = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)).lower()


def sliced_words(text: bytes) -> Iterator[tuple[list[bytes], int]]:
    """Words of a text, slice by slice, each after the last NGRAM - 1 words before it; how many those are."""
    text, at, before = text.translate(_WORD_BYTES), 0, []
    while at < len(text):
        end = min(at + SLICE, len(text))
        if end < len(text):
            cut = text.rfind(b" ", at, end)
            cut = text.find(b" ", end) if cut < 0 else cut
            end = len(text) if cut < 0 else cut + 1
        words = before + text[at:end].split()
        yield words, len(before)
        before, at = words[-(NGRAM - 1) :], end


def features(words: list[bytes], old: int) -> list[np.ndarray]:
    """Buckets of the runs of 1 to NGRAM words that end after the first `old` words."""
    sums = list(map(crc32, words))
    out = [np.array(sums[old:], np.int64)]
    joined = [b" " + w for w in words]
    for n in range(1, NGRAM):
        if n >= len(words):
            break
        sums = list(map(crc32, joined[n:], sums))  # of n + 1 words: the checksum of n goes on through the next
        out.append(np.array(sums[max(old - n, 0) :], np.int64))
    return [x % BUCKETS for x in out]


def _texts(batch: pa.RecordBatch, name: str) -> Iterator[bytes | None]:
    for x in batch.column(batch.schema.get_field_index(name)).cast(pa.large_binary()):
        yield x.as_py()


def bucket_counts(docs: DataFrame) -> np.ndarray:
    """How often the features of all texts fall into each bucket. Null texts have none."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held, waiting = np.zeros(BUCKETS, np.int64), [], 0
        for batch in batches:
            for text in _texts(batch, "text"):
                for words, old in sliced_words(text or b""):
                    held += features(words, old)
                    waiting += 3 * (len(words) - old)
                    if waiting >= GATHERED:
                        total += np.bincount(np.concatenate(held), minlength=BUCKETS)
                        held, waiting = [], 0
        if held:
            total += np.bincount(np.concatenate(held), minlength=BUCKETS)
        yield pa.RecordBatch.from_pydict({"counts": pa.array([total.tobytes()], pa.binary())})

    vectors = docs.select("text").mapInArrow(counted, "counts binary").rdd.map(lambda r: np.frombuffer(r["counts"], np.int64))
    if not vectors.getNumPartitions():
        return np.zeros(BUCKETS, np.int64)
    depth = max(2, math.ceil(math.log(vectors.getNumPartitions(), 32)))
    return vectors.treeReduce(np.add, depth)


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln of the target's smoothed share of a bucket by the source's)."""
    all_s, all_t = float(source.sum() + BUCKETS), float(target.sum() + BUCKETS)
    return np.array([math.floor(1000 * math.log((float(t + 1) * all_s) / (float(s + 1) * all_t))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def weighted(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """docs (doc_id, text) with n_words, n_features and weight (the sum of the gains of its features) in place of the text."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, n_features long, weight long"

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = shared.value.astype(float)
        for batch in batches:
            n_words, n_features, weight = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
            held: list[np.ndarray] = []
            owner: list[tuple[int, int]] = []

            def flush() -> None:
                if held:
                    who = np.repeat([d for d, _ in owner], [n for _, n in owner])
                    sums = np.bincount(who, weights=gain[np.concatenate(held)], minlength=batch.num_rows)  # whole numbers far below 2^53
                    weight[:] += sums.astype(np.int64)
                    held.clear()
                    owner.clear()

            waiting = 0
            for d, text in enumerate(_texts(batch, "text")):
                for words, old in sliced_words(text or b""):
                    n_words[d] += len(words) - old
                    for found in features(words, old):
                        n_features[d] += len(found)
                        held.append(found)
                        owner.append((d, len(found)))
                        waiting += len(found)
                    if waiting >= GATHERED:
                        flush()
                        waiting = 0
            flush()
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("doc_id")), *map(pa.array, (n_words, n_features, weight))], ["doc_id", "n_words", "n_features", "weight"])

    return docs.select("doc_id", "text").mapInArrow(summed, schema)


def gumbel(doc_id: Column, seed: int = 42) -> Column:
    """floor(-1000 * ln(-ln(u))) of a number u between 0 and 1 that the seed and the id decide."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, seed: int = 42) -> DataFrame:
    """docs to doc_id, n_features, weight, score, rank: floor(percent * N / 100) documents drawn towards `target`'s texts.

    N documents with at least `least_words` words can be drawn; those with the highest scores are, ties by smaller id
    (null first), then by fewer features and smaller weight. rank counts 1, 2, 3 in that order and is null for all
    others. Every row is returned: null and empty texts have no features and weight 0; a null id has the Gumbel number
    of the empty string; repeated rows are documents of their own with equal scores. An empty target leaves the gains to the
    smoothing; an empty docs gives no rows. Only doc_id and text are read: other columns, whatever their
    names, play no part.
    """
    spark = docs.sparkSession
    gain = gains(bucket_counts(docs), bucket_counts(target))
    scored = weighted(docs, gain).withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed))
    scored = written(scored.withColumn("able", F.col("n_words") >= least_words).drop("n_words"), "importance-scored")
    order = [F.desc("score"), F.asc_nulls_first("doc_id"), F.col("n_features"), F.col("weight")]
    able = scored.filter("able")
    n = able.count()
    # ranks: rows in order of range, numbered within each partition; the partitions' counts are all that the driver sees
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // 1_000_000))
    ordered = able.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id())
    ordered = written(ordered, "importance-ordered")
    of, place = F.shiftright("place", 33), F.col("place").bitwiseAND((1 << 33) - 1)
    before, starts = 0, []
    for part, count in sorted(ordered.groupBy(of.alias("part")).count().collect()):  # a row for each partition
        starts.append((part, before))
        before += count
    starts = F.broadcast(spark.createDataFrame(starts, "part long, before long"))
    rank = F.col("before") + place + 1
    drawn = percent * n // 100
    ranked = ordered.withColumn("part", of).join(starts, "part").withColumn("rank", F.when(rank <= drawn, rank))
    columns = ["doc_id", "n_features", "weight", "score", "rank"]
    return ranked.select(*columns).unionByName(scored.filter(~F.col("able")).withColumn("rank", F.lit(None).cast("long")).select(*columns))


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(spread_table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
