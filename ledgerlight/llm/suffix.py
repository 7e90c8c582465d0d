"""Removal of repeated byte strings through run-length suffix indexes.

A string of SIZE bytes is a duplicate if it starts anywhere else in the corpus. Every SIZE-byte
window has an anchor: among its GRAM-byte substrings the one of least hash (the first, at a tie).
Equal windows have equal anchors, so it's enough to hold windows with one anchor against each
other. The windows that share one anchor position in a document form a run of at most
SIZE - GRAM + 1 windows; its segment is the bytes that they cover.

1. Every document gives its runs: the hash of the anchor, the hash of the segment.
2. An anchor that occurs once has no duplicates. Where all segments of an anchor are equal, and where a
   segment occurs twice, all its windows are duplicates.
3. The distinct segments of the other anchors go, by anchor, to indexes of bounded size. An
   index is the run-length compressed Burrows-Wheeler transform of its segments with the suffixes
   at the ends of the runs as samples. Only at those the longest match with the neighbouring suffix is
   compared; from there matching statistics stream along the text, falling by one with each
   byte, since within a run neighbours stay neighbours one byte earlier. Windows with a match of SIZE
   bytes or more are duplicates.
4. An anchor with more than HOT distinct segments would make an index too large for a task. Its
   windows are counted by a 128-bit hash of their bytes instead, in as many tasks as there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import give_back, parts_for, removed, table, text_key, written

SIZE, GRAM = 200, 64
#: Bytes that one scanning step holds, of one index, and the most distinct segments of an indexed anchor.
STEP, INDEX_BYTES, HOT = 1 << 20, 1 << 20, 8000

_RNG = np.random.default_rng(31337)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = int(_RNG.integers(0, 1 << 62)) * 2 + 1
_BASE2 = int(_RNG.integers(0, 1 << 62)) * 2 + 1
_POS = np.uint64((1 << 24) - 1)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, STEP + (STEP >> 1)), base, np.uint64)
        steps[0] = 1
        have = _powers[base] = np.multiply.accumulate(steps)
    return have[:n]


def _substring_hash(values: np.ndarray, base: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Polynomial hashes modulo 2^64 of values[start:end]."""
    inverse = pow(base, -1, 1 << 64)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _power(base, len(values)), out=sums[1:])
    return (sums[end] - sums[start]) * _power(inverse, len(values) + 1)[start]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def runs_of(data: np.ndarray, ends: np.ndarray, size: int = SIZE, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Runs of the windows of several texts, joined in data and ending at ends.

    Returns the start and number of each run's windows, its anchor's hash and its segment's hash.
    """
    none = (np.zeros(0, np.int64),) * 4
    if len(data) < size:
        return none
    valid = np.zeros(len(data) + 1, np.int32)
    begins = np.concatenate([[0], ends[:-1]])
    has = ends - begins >= size
    np.add.at(valid, begins[has], 1)
    np.add.at(valid, ends[has] - size + 1, -1)
    ok = np.flatnonzero(np.cumsum(valid[:-1])[: len(data) - size + 1])
    if not len(ok):
        return none
    values = _BYTE[data]
    grams, span = values, 1
    while span < gram:  # gram is a power of two
        grams = grams[:-span] * np.uint64(pow(_BASE, span, 1 << 64)) + grams[span:]
        span *= 2
    least = (_mix(grams) & ~_POS) | np.arange(len(grams), dtype=np.uint64)
    span, wanted = 1, size - gram + 1
    while 2 * span <= wanted:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < wanted:
        least = np.minimum(least[: len(least) - (wanted - span)], least[wanted - span :])
    anchor = (least[ok] & _POS).astype(np.int64)
    cut = np.flatnonzero((anchor[1:] != anchor[:-1]) | (ok[1:] != ok[:-1] + 1)) + 1
    first = np.concatenate([[0], cut])
    number = np.diff(np.concatenate([first, [len(ok)]]))
    start = ok[first]
    segment = _substring_hash(values, _BASE2, start, start + number + size - 1)
    return start, number, grams[anchor[first]].view(np.int64), _mix(segment + number.astype(np.uint64)).view(np.int64)


def _pieces(texts: list[bytes], size: int) -> Iterator[tuple[list[int], list[int], bytes, np.ndarray]]:
    """Texts in steps of bounded size: whose, from which byte, joined bytes, ends. Long texts overlap by size - 1."""
    who, at, parts, held = [], [], [], 0
    for i, t in enumerate(texts):
        for begin in range(0, max(len(t) - size + 1, 0), STEP):
            piece = t[begin : begin + STEP + size - 1]
            if held and held + len(piece) > STEP:
                yield who, at, b"".join(parts), np.cumsum([len(p) for p in parts])
                who, at, parts, held = [], [], [], 0
            who.append(i), at.append(begin), parts.append(piece)
            held += len(piece)
    if parts:
        yield who, at, b"".join(parts), np.cumsum([len(p) for p in parts])


def scan(docs: DataFrame, size: int, gram: int) -> DataFrame:
    def scanned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = [t.encode() if t is not None else b"" for t in b["text"]]
            for who, at, joined, ends in _pieces(texts, size):
                start, number, anchor, segment = runs_of(np.frombuffer(joined, np.uint8), ends, size, gram)
                piece = np.searchsorted(ends, start, side="right")
                rows, begins = np.array(who)[piece], np.concatenate([[0], ends[:-1]])
                yield pd.DataFrame({
                    "doc_id": b["doc_id"].iloc[rows].to_numpy(), "key": b["key"].iloc[rows].to_numpy(),
                    "start": start - begins[piece] + np.array(at)[piece], "number": number, "anchor": anchor, "segment": segment,
                })
            give_back()

    return docs.mapInPandas(scanned, "doc_id long, key long, start long, number int, anchor long, segment long")


def suffix_order(symbols: np.ndarray, rest: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """Suffix array by prefix doubling, and the ranks by the first 7, 14, 28, ... symbols.

    Separators (rest 0) are symbols of their own, in the order of their segments.
    """
    n, m = len(symbols), int(owner[-1]) + 1
    packed = np.zeros(n, np.int64)
    for j in range(7):
        packed <<= 9
        packed[: n - j] |= np.where(rest[: n - j] > j, symbols[j:], 0)

    def ranked(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(key)
        new = np.empty(n, bool)
        new[0] = False
        sorted_ = key[order]
        new[1:] = sorted_[1:] != sorted_[:-1]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new)
        return order, rank

    order, rank = ranked(packed)
    length, levels = 7, []
    while True:
        # a suffix that ends within `length` symbols is told apart by its separator
        nxt = np.zeros(n, np.int64)
        nxt[: n - length] = m + rank[length:] if length < n else 0
        second = np.where(rest >= length, nxt, owner)
        levels.append((length, rank))
        if rank.max() == n - 1 or length > int(rest.max()):
            order, rank = ranked(rank * (n + m + 1) + second)
            return order, levels
        order, rank = ranked(rank * (n + m + 1) + second)
        length *= 2


def matching_statistics(segments: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The longest match of each position with any other position, and the first position of each segment."""
    lengths = np.array([len(s) for s in segments])
    first = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])
    n = int(lengths.sum()) + len(segments)
    symbols = np.zeros(n, np.int64)
    inside = np.ones(n, bool)
    inside[first + lengths] = False
    symbols[inside] = np.frombuffer(b"".join(segments), np.uint8).astype(np.int64) + 1
    owner = np.repeat(np.arange(len(segments)), lengths + 1)
    rest = np.repeat(first + lengths, lengths + 1) - np.arange(n)
    order, levels = suffix_order(symbols, rest, owner)
    # the transform; a separator before a suffix equals no other one
    before = symbols[order - 1]
    breaks = np.ones(n + 1, bool)
    breaks[1:n] = (before[1:] != before[:-1]) | (before[1:] == 0)
    heads, tails = np.flatnonzero(breaks[:n]), np.flatnonzero(breaks[1:])
    samples = order[heads], order[tails]  # suffixes at the first and last row of each run

    def common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        got = np.zeros(len(a), np.int64)
        for length, rank in reversed(levels):
            x, y = np.minimum(a + got, n - 1), np.minimum(b + got, n - 1)
            got += np.where((rank[x] == rank[y]) & (rest[x] >= length) & (rest[y] >= length), length, 0)
        for _ in range(6):
            x, y = np.minimum(a + got, n - 1), np.minimum(b + got, n - 1)
            got += (symbols[x] == symbols[y]) & (symbols[x] > 0)
        return got

    def streamed(at: np.ndarray, other: np.ndarray) -> np.ndarray:
        """Matches with the neighbour, from the samples on."""
        sampled, value = np.zeros(n, np.int64), np.zeros(n, np.int64)
        sampled[at] = at
        value[at] = other
        last = np.maximum.accumulate(sampled)
        return value[last] - (np.arange(n) - last)

    above = np.zeros(len(heads), np.int64)
    above[1:] = common(samples[0][1:], order[heads[1:] - 1])
    below = np.zeros(len(tails), np.int64)
    below[:-1] = common(samples[1][:-1], order[tails[:-1] + 1])
    return np.maximum(streamed(samples[0], above), streamed(samples[1], below)), first


def _true_runs(flags: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


MARKS = "anchor long, segment long, number int, marks array<struct<a: int, b: int>>"


def _indexed(distinct: DataFrame, size: int) -> DataFrame:
    """Marks of the windows of segments (anchor, segment, number, bytes) that another segment of its anchor holds."""

    def index(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["anchor", "segment", "number"]).reset_index(drop=True)
        stats, first = matching_statistics(g["bytes"].tolist())
        marks = [[{"a": a, "b": b} for a, b in _true_runs(stats[f : f + n] >= size)] for f, n in zip(first.tolist(), g["number"].tolist(), strict=True)]
        del stats, first
        give_back()
        return g[["anchor", "segment", "number"]].assign(marks=marks)

    total = distinct.agg(F.sum(F.length("bytes"))).first()[0] or 0
    buckets = max(1, -(-total // INDEX_BYTES))
    # as many tasks as buckets: an index is work for a processor, however few bytes it has
    dealt = distinct.withColumn("bucket", F.pmod(F.xxhash64("anchor"), F.lit(buckets))).repartition(parts_for(buckets, 1, distinct.sparkSession), "bucket")
    return dealt.groupBy("bucket").applyInPandas(index, MARKS)


def _counted(distinct: DataFrame, size: int) -> DataFrame:
    """The same for anchors with many segments: windows are counted by the hash of their bytes."""

    def windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for anchor, segment, number, data in zip(b["anchor"], b["segment"], b["number"], b["bytes"], strict=True):
                values, at = _BYTE[np.frombuffer(data, np.uint8)], np.arange(number)
                h1, h2 = (_mix(_substring_hash(values, base, at, at + size)).view(np.int64) for base in (_BASE, _BASE2))
                yield pd.DataFrame({"anchor": anchor, "segment": segment, "number": number, "a": at, "h1": h1, "h2": h2})

    each = written(distinct.mapInPandas(windows, "anchor long, segment long, number int, a int, h1 long, h2 long"), "suffix-windows")
    twice = each.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h1", "h2")
    # neighbouring windows make one mark: a segment has SIZE - GRAM + 1 windows at most, so no more are gathered for it
    found = each.join(twice, ["h1", "h2"]).groupBy("anchor", "segment", "number").agg(F.collect_set("a").alias("at"))
    first = F.array_sort(F.filter("at", lambda a: ~F.array_contains("at", a - 1)))
    last = F.array_sort(F.filter("at", lambda a: ~F.array_contains("at", a + 1)))
    return found.select("anchor", "segment", "number", F.zip_with(first, last, lambda a, b: F.struct(a.alias("a"), (b + 1).alias("b"))).alias("marks"))


def remove_repeats(docs: DataFrame, size: int = SIZE, gram: int = GRAM, hot: int = HOT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, spans (removed byte ranges, end exclusive) and kept (bytes) for every row of docs.

    Every byte that a repeated string of `size` bytes covers goes. Null and empty texts have no bytes
    and no spans. Repeated rows repeat each other, so all their strings are duplicates. Texts shorter
    than `size` stay. An empty table gives no rows. Only the id and the text are read: other columns, whatever their
    names, play no part.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_key(F.col(text_col)).alias("key"), F.col(text_col).alias("text"))
    runs = written(scan(docs, size, gram), "suffix-runs")
    anchors = runs.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.min("segment").alias("low"), F.max("segment").alias("high"))
    # written, so that the join has a plain table on each side, and a frequent anchor's runs can be split
    repeated = written(anchors.filter("n > 1").select("anchor", (F.col("low") != F.col("high")).alias("differ")), "suffix-anchors")
    shared = written(runs.join(repeated, "anchor"), "suffix-shared")
    removed(runs, repeated)
    differ = shared.filter("differ")
    where = F.min(F.struct("doc_id", "key", "start")).alias("at")
    distinct = written(differ.groupBy("anchor", "segment", "number").agg(F.count(F.lit(1)).alias("n"), where), "suffix-distinct")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for text, found in zip(b["text"], b["found"], strict=True):
                data = text.encode()
                yield pd.DataFrame([(x["anchor"], x["segment"], x["number"], data[x["start"] : x["start"] + x["number"] + size - 1]) for x in found],
                                   columns=["anchor", "segment", "number", "bytes"])

    asked = distinct.select("anchor", "segment", "number", "at.*").groupBy("doc_id", "key").agg(F.collect_list(F.struct("anchor", "segment", "number", "start")).alias("found"))
    same = lambda a, b: (F.col(f"{a}.key") == F.col(f"{b}.key")) & F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id"))
    one_each = docs.alias("d").join(asked.alias("a"), same("d", "a")).select("d.text", "a.found")
    segments = written(one_each.mapInPandas(cut, "anchor long, segment long, number int, bytes binary").dropDuplicates(["anchor", "segment", "number"]), "suffix-segments")
    many = written(distinct.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > hot).select("anchor"), "suffix-many")
    marks = written(_indexed(segments.join(many, "anchor", "left_anti"), size).unionByName(_counted(segments.join(many, "anchor", "left_semi"), size)), "suffix-marks")
    whole = shared.filter("not differ").select("doc_id", "key", "start", "number")
    twice = differ.join(distinct.filter("n > 1").select("anchor", "segment", "number"), ["anchor", "segment", "number"], "left_semi").select("doc_id", "key", "start", "number")
    part = differ.join(marks.select("anchor", "segment", "number", F.explode("marks").alias("m")), ["anchor", "segment", "number"]).select(
        "doc_id", "key", (F.col("start") + F.col("m.a")).alias("start"), (F.col("m.b") - F.col("m.a")).alias("number")
    )
    ranges = whole.unionByName(twice).unionByName(part).groupBy("doc_id", "key").agg(
        F.collect_list(F.struct("start", (F.col("start") + F.col("number") + size - 1).alias("end"))).alias("ranges")
    )

    def kept(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            spans, left = [], []
            for text, found in zip(b["text"], b["ranges"], strict=True):
                data = text.encode() if text is not None else b""
                out: list[list[int]] = []
                for x in sorted(found, key=lambda x: x["start"]) if found is not None else []:
                    if out and x["start"] <= out[-1][1]:
                        out[-1][1] = max(out[-1][1], x["end"])
                    else:
                        out.append([x["start"], x["end"]])
                cuts = [0, *(i for o in out for i in o), len(data)]
                left.append(b"".join(data[i:j] for i, j in zip(cuts[::2], cuts[1::2], strict=True)))
                spans.append([{"start": i, "end": j} for i, j in out])
            yield pd.DataFrame({"doc_id": b["doc_id"], "n_bytes": b["n_bytes"], "spans": spans, "kept": left})
            del spans, left
            give_back()

    rows = docs.alias("d").join(ranges.alias("a"), same("d", "a"), "left").select("d.doc_id", F.coalesce(F.octet_length("d.text"), F.lit(0)).cast("long").alias("n_bytes"), "d.text", "a.ranges")
    return rows.mapInPandas(kept, "doc_id long, n_bytes long, spans array<struct<start: long, end: long>>, kept binary")


def op7_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
