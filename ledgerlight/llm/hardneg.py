"""Hard negatives by bit-sliced integer products.

Components are whole numbers; a candidate is stored as its bit planes (two's complement, most
significant first), one packed run of bits for each plane. With the top planes of a candidate known, the
rest of each component lies between 0 and 2^r - 1, so its product with an anchor lies between

    known + (2^r - 1) * (sum of the anchor's negative components)
    known + (2^r - 1) * (sum of the anchor's positive components).

A sweep takes plane after plane. After each it drops the candidates whose interval can't qualify: it
lies outside of all windows that the anchor asks for, or a window has k candidates already whose lower ends are
above it. Once few pairs are left, the planes that follow are read for those pairs alone. What is left
after the last plane has an exact score.

The first sweep has one open window: the best rows of the anchor's own label (positives). The second has
a window for each positive, and the rows of other labels (negatives). Anchors and candidates meet in blocks:
each is dealt by a hash of its id, so a label or vector with a third of all rows lands in all
blocks alike. A block of candidates is swept in chunks, and what the chunks before have found bounds the next.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written
from .vectors import finite

#: Rows of a block, at most, and rows below which a block isn't divided further.
MOST_CANDIDATES, MOST_ANCHORS, LEAST_CANDIDATES = 65_536, 4096, 1024
#: Candidates and anchors that a sweep holds scores of at a time.
CHUNK, ANCHORS = 4096, 128
#: Below this share of live pairs a plane is read for those alone.
SPARSE = 0.12
EXACT, LONG = 1 << 53, (1 << 63) - 1
#: Beyond every product of whole numbers that doubles can hold.
FAR = 1 << 4200


def planes_of(top: float) -> int:
    """Bits in two's complement for whole numbers whose absolute value is at most floor(top) + 1."""
    return (math.floor(top) + 1).bit_length() + 1


def sliced(rows: np.ndarray, bits: int) -> list[bytes]:
    """Rows of whole doubles to their bit planes, the sign's plane first, each packed to whole bytes."""
    if bits <= 62:
        v = rows.astype(np.int64)
    else:
        v = np.array([[int(x) for x in r] for r in rows], object).reshape(rows.shape)
    planes = [np.packbits(((v >> j) & 1).astype(np.uint8), axis=1) for j in range(bits - 1, -1, -1)]
    return [r.tobytes() for r in np.ascontiguousarray(np.stack(planes, axis=1))]


def planes(packed: list[bytes], bits: int, width: int, kind: type) -> np.ndarray:
    """What `sliced` gave, as (plane, row, component) of zeros and ones."""
    raw = np.frombuffer(b"".join(packed), np.uint8).reshape(len(packed), bits, -(-width // 8))
    return np.unpackbits(raw, axis=2, count=width).transpose(1, 0, 2).astype(kind)


class Windows:
    """The k best (score, then least id) that each anchor has found within each of its windows so far."""

    def __init__(self, low: np.ndarray, high: np.ndarray, k: int) -> None:
        self.low, self.high, self.k = low, high, k
        self.found: list[list[list[tuple]]] = [[[] for _ in range(low.shape[1])] for _ in low]  # (-score, id)

    def floor(self, at: np.ndarray) -> np.ndarray:
        """What a score has to reach in each window of the anchors `at`."""
        out = self.low[at]
        for i, a in enumerate(at.tolist()):
            for w, best in enumerate(self.found[a]):
                if len(best) == self.k:
                    out[i, w] = max(out[i, w], -best[-1][0])
        return out

    def add(self, anchor: int, scores: np.ndarray, ids: np.ndarray) -> None:
        order = np.lexsort((ids, -scores)) if scores.dtype != object else np.array(sorted(range(len(ids)), key=lambda i: (-scores[i], ids[i])), np.int64)
        scores, ids = scores[order], ids[order]
        for w, (low, high) in enumerate(zip(self.low[anchor], self.high[anchor], strict=True)):
            inside = np.flatnonzero((scores >= low) & (scores <= high))[: self.k]
            if len(inside):
                new = [(-s, i) for s, i in zip(scores[inside].tolist(), ids[inside].tolist(), strict=True)]
                self.found[anchor][w] = sorted(self.found[anchor][w] + new)[: self.k]


def _kth(a: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest of each row."""
    return np.sort(a, axis=1)[:, -k] if a.dtype == object else np.partition(a, a.shape[1] - k, axis=1)[:, a.shape[1] - k]


def _clip(a: np.ndarray) -> np.ndarray:
    """Beyond a long, the nearest long."""
    return np.minimum(np.maximum(a, -LONG - 1), LONG) if a.dtype == object else a


def sweep(q: np.ndarray, sets: np.ndarray, ids: np.ndarray, allowed: np.ndarray, windows: Windows, at: np.ndarray) -> None:
    """Anchors q (a, d) over candidates given as planes (plane, c, d); what qualifies goes to `windows` at rows `at`.

    allowed (a, c): the pairs that count.
    """
    bits, kind = len(sets), object if q.dtype == object else float
    weight = [2**j for j in range(bits - 1, -1, -1)]
    weight[0] = -weight[0]
    positive, negative = np.maximum(q, 0).sum(axis=1), np.minimum(q, 0).sum(axis=1)
    none = -FAR if kind is object else -np.inf
    # planes whose interval is wider than the scores are apart can't drop anything: they're read together
    first = 1
    if kind is not object:
        apart = np.abs(q).mean() * math.sqrt(q.shape[1]) * 2.0 ** (bits - 3)
        while first < bits and (positive - negative).mean() * (2 ** (bits - first) - 1) > apart:
            first += 1
    known = sum(w * p for w, p in zip(weight[:first], sets[:first], strict=True))
    score, alive = q @ known.T, allowed.copy()
    floor, high_end = windows.floor(at), windows.high[at]
    done = first
    while True:
        rest = 2 ** (bits - done) - 1
        low, high = _clip(score + rest * negative[:, None]), _clip(score + rest * positive[:, None])
        live = np.zeros_like(alive)
        for w in range(floor.shape[1]):
            least, most = floor[:, w : w + 1], high_end[:, w : w + 1]
            sure = np.where(alive & (low >= least) & (high <= most), low, none)
            if sure.shape[1] >= windows.k:
                least = np.maximum(least, _kth(sure, windows.k)[:, None])
            live |= (high >= least) & (low <= most)
        alive &= live.astype(bool)
        if done == bits or not alive.any():
            break
        cols = np.flatnonzero(alive.any(axis=0))
        if len(cols) < 0.7 * alive.shape[1]:
            score, alive, sets, ids = score[:, cols], alive[:, cols], sets[:, cols], ids[cols]
        plane, w = sets[done], weight[done]
        if alive.mean() < SPARSE:
            i, j = np.nonzero(alive)
            score[i, j] += w * ((q[i] * plane[j]).sum(axis=1) if kind is object else np.einsum("pd,pd->p", q[i], plane[j]))
        else:
            score += w * (q @ plane.T)
        done += 1
    score = _clip(score)
    for a in np.flatnonzero(alive.any(axis=1)).tolist():
        of = np.flatnonzero(alive[a])
        windows.add(at[a], score[a, of], ids[of])


def _ends(lows: list, highs: list, exact: bool) -> tuple[np.ndarray, np.ndarray]:
    kind = float if exact else object
    return np.array(lows, kind).reshape(len(lows), -1), np.array(highs, kind).reshape(len(highs), -1)


def hard_negatives(rows: DataFrame, is_anchor, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: int = 256) -> DataFrame:
    """rows (id, vec, label) to anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Components become floor(scale * x); a score is an integer inner product with the anchor (beyond a long: the
    nearest long). An anchor's positives are the `positives` best other rows of its label; for each, the
    `negatives` best rows of other labels with low * positive <= 100 * negative <= high * positive are returned.

    Higher scores come first, ties by smaller id. Rows with a null id, label or vector, an empty vector, or a null or
    non-finite component take no part. Shorter vectors are continued with zeros; a zero vector takes part. Of rows with one id the one with the
    least (label, vector) takes part. Anchors with no positive, and positives with no negative, give no rows; neither does
    an empty table. Other columns, whatever their names, play no part.
    """
    spark = rows.sparkSession
    out_schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    rows = rows.select("id", "label", F.transform("vec", lambda x: x.cast("double")).alias("vec")).filter(F.col("id").isNotNull() & F.col("label").isNotNull() & finite(F.col("vec")))
    if rows.groupBy("id").count().filter("count > 1").limit(1).count():
        rows = rows.groupBy("id").agg(F.min(F.struct("label", "vec")).alias("of")).select("id", "of.label", "of.vec")
    n, width, top, anchors = rows.agg(F.count(F.lit(1)), F.max(F.size("vec")), F.max(F.array_max(F.transform("vec", F.abs))), F.count_if(is_anchor(F.col("id")))).first()
    if not n or not anchors:
        return spark.createDataFrame([], out_schema)
    bits = planes_of(min(top * scale, np.finfo(float).max))
    exact = width * (1 << bits) * (1 << bits) < EXACT
    kind = float if exact else object

    def whole(vectors: pd.Series) -> np.ndarray:
        v = np.zeros((len(vectors), width))
        for i, x in enumerate(vectors):
            v[i, : len(x)] = x
        with np.errstate(over="ignore"):
            return np.clip(np.floor(v * scale), -np.finfo(float).max, np.finfo(float).max)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield pd.DataFrame({"id": b["id"], "label": b["label"], "planes": sliced(whole(b["vec"]), bits)})

    label = rows.schema["label"].dataType.simpleString()
    candidates = written(rows.mapInPandas(cut, f"id long, label {label}, planes binary"), "hardneg-planes")
    asked = rows.filter(is_anchor(F.col("id")))
    a_blocks = -(-anchors // MOST_ANCHORS)
    tasks = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    c_blocks = max(-(-n // MOST_CANDIDATES), min(-(-n // LEAST_CANDIDATES), -(-tasks // a_blocks)))

    def met(asking: DataFrame, run, schema: str) -> DataFrame:
        """run(anchors, candidates) for each pair of blocks."""
        every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
        dealt = lambda k: F.pmod(F.xxhash64("id"), F.lit(k)).cast("int")
        left = asking.withColumn("a", dealt(a_blocks)).withColumn("c", every(c_blocks))
        right = candidates.withColumn("c", dealt(c_blocks)).withColumn("a", every(a_blocks))
        return left.groupBy("a", "c").cogroup(right.groupBy("a", "c")).applyInPandas(run, schema)

    def best_positives(ask: pd.DataFrame, of: pd.DataFrame) -> pd.DataFrame:
        out = []
        for name, group in ask.groupby("label"):
            same, group = of[of["label"] == name], group.reset_index(drop=True)
            if not len(same):
                continue
            far = float("inf") if exact else FAR
            windows = Windows(*_ends([[-far]] * len(group), [[far]] * len(group), exact), positives)
            _swept(group, same, windows, lambda g, c: g["id"].to_numpy()[:, None] != c["id"].to_numpy()[None, :])
            out += [(a, i, int(-s)) for a, of_a in zip(group["id"], windows.found, strict=True) for s, i in of_a[0]]
        return pd.DataFrame(out, columns=["anchor_id", "positive_id", "positive_score"])

    def best_negatives(ask: pd.DataFrame, of: pd.DataFrame) -> pd.DataFrame:
        out = []
        # a product that a double holds exactly has ends that it holds too, but Python's whole numbers divide without rounding
        lows = [[-(-low * int(s) // 100) for s in p] + [1] * (positives - len(p)) for p in ask["scores"]]
        highs = [[high * int(s) // 100 for s in p] + [0] * (positives - len(p)) for p in ask["scores"]]
        if len(ask) and len(of):
            windows = Windows(*_ends(lows, highs, exact), negatives)
            _swept(ask, of, windows, lambda g, c: g["label"].to_numpy()[:, None] != c["label"].to_numpy()[None, :])
            for a, ids, scores, of_a in zip(ask["id"], ask["ids"], ask["scores"], windows.found, strict=True):
                for p, s, best in zip(ids, scores, of_a, strict=False):
                    out += [(a, int(p), int(s), i, int(-t)) for t, i in best]
        return pd.DataFrame(out, columns=["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"])

    def _swept(ask: pd.DataFrame, of: pd.DataFrame, windows: Windows, allowed) -> None:
        q = whole(ask["vec"])
        q = q if exact else np.array([[int(x) for x in r] for r in q], object).reshape(q.shape)
        of = of.sort_values("id")
        for c in range(0, len(of), CHUNK):
            some = of.iloc[c : c + CHUNK]
            sets, ids = planes(some["planes"].tolist(), bits, width, kind), some["id"].to_numpy()
            for a in range(0, len(ask), ANCHORS):
                at = np.arange(a, min(a + ANCHORS, len(ask)))
                sweep(q[at], sets, ids, allowed(ask.iloc[at], some), windows, at)

    def first(found: DataFrame, by: list[str], score: str, of: str, k: int) -> DataFrame:
        order = Window.partitionBy(*by).orderBy(F.desc(score), of)
        return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

    found = met(asked, best_positives, "anchor_id long, positive_id long, positive_score long")
    found = first(found, ["anchor_id"], "positive_score", "positive_id", positives)
    held = found.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("rank", "positive_id", "positive_score"))).alias("p"))  # `positives` at most
    asking = asked.join(held, asked["id"] == held["anchor_id"]).select("id", "label", "vec", F.col("p.positive_id").alias("ids"), F.col("p.positive_score").alias("scores"))
    found = met(written(asking, "hardneg-asked"), best_negatives, "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long")
    found = first(found, ["anchor_id", "positive_id"], "negative_score", "negative_id", negatives)
    return found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op11_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), label.alias("label")), lambda i: i % 50 == 0)
