"""MinHash near-duplicates by a multi-index Hamming join.

A document's set of word shingles has a signature of HASHES symbols, the low bits of its
minimal hashes. Two sets of Jaccard similarity s differ in about HASHES * (1 - s) symbols; the
join finds all pairs that differ in at most `distance` symbols, the least number that a pair of just the
wanted similarity exceeds with a probability of at most MISS. By the pigeonhole principle, of m chunks of
the signature one has at most distance // m wrong symbols; m is the least number that makes this
MOST_ERRORS. Each chunk gives one key for every way to blank that many of its symbols, so two
signatures within the distance share a key for certain.

Equal sets are one node. The nodes of a key (a bucket) that are within the distance form trees: each
node is held only against those that no tree has reached, so a group of n near copies costs about n
comparisons for each key, and gives n edges, not n squared. The trees of all buckets join to
families. Within a family, every pair's sets are intersected in full, as products of incidence
matrices, and again only a spanning forest of the links leaves the task. Large buckets and
families are dealt to cells of bounded size, in two rounds: the second holds only against each other what
the first has left in different components.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import removed, table, written
from .shingles import mixed, overlaps, shingle_sets

HASHES, MOST_ERRORS = 64, 1
#: Probability at which the signatures of a pair of exactly the wanted similarity are too far apart; it falls fast above that.
MISS = 1e-7
#: Signatures of a bucket, and texts of a family, in one block; a cell holds two blocks at most.
SIGNATURES, TEXTS = 4096, 512
#: Documents whose shingles a task holds at once.
STEP = 1000

_RNG = np.random.default_rng(99173)
_A = _RNG.integers(0, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 1 << 63, HASHES, dtype=np.uint64)
_KEY = _RNG.integers(0, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signature(shingles: np.ndarray) -> np.ndarray:
    least = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 2048):
        np.minimum(least, (shingles[at : at + 2048, None] * _A + _B).min(axis=0), out=least)
    return (mixed(least) >> np.uint64(48)).astype(np.uint16)


def plan(similarity: float) -> tuple[int, list[tuple[int, ...]]]:
    """The signature distance, and the symbols of each key."""
    tail, distance = 1.0, -1  # tail: the probability of more than `distance` differing symbols
    while tail > MISS and distance < HASHES - 1:
        distance += 1
        tail = sum(math.comb(HASHES, d) * (1 - similarity) ** d * similarity ** (HASHES - d) for d in range(distance + 1, HASHES + 1))
    chunks = distance // (MOST_ERRORS + 1) + 1
    edges = [round(i * HASHES / chunks) for i in range(chunks + 1)]
    keys = []
    for a, b in zip(edges, edges[1:], strict=False):
        wrong = min(MOST_ERRORS, b - a - 1)
        keys += [tuple(x for x in range(a, b) if x not in blank) for blank in combinations(range(a, b), wrong)]
    return distance, keys


def _keys(signatures: np.ndarray, keys: list[tuple[int, ...]]) -> np.ndarray:
    wide = (signatures.astype(np.uint64) + np.uint64(1)) * _KEY
    out = np.empty((len(signatures), len(keys)), np.uint64)
    for i, symbols in enumerate(keys):
        out[:, i] = mixed(mixed(wide[:, list(symbols)].sum(axis=1, dtype=np.uint64)) + np.uint64(i))
    return out.view(np.int64)


def signatures(docs: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, n, f1, f2 (of the set) and sig of every document."""

    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in (whole.iloc[at : at + STEP] for whole in batches for at in range(0, len(whole), STEP)):
            sets = shingle_sets([None if t is None else t.encode() for t in b["text"]], k)
            yield pd.DataFrame({
                "doc_id": b["doc_id"], "n": [len(s) for s in sets],
                "f1": np.array([s.sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64),
                "f2": np.array([np.bitwise_xor.reduce(mixed(s + np.uint64(7)), initial=np.uint64(0)) for s in sets], np.uint64).view(np.int64),
                "sig": [signature(s).tobytes() if len(s) else b"" for s in sets],
            })

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(made, "doc_id long, n long, f1 long, f2 long, sig binary")


def components(links: DataFrame, what: str) -> DataFrame:
    """links (a, b) to node, component for all their nodes: the least node reachable.

    Each round, a node takes the least label among its neighbours and itself, then the label of
    that label; the rounds end when no label changes.
    """
    ways = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))  # links are made once for both
    both = written(links.select(F.explode(ways).alias("way")).select("way.a", "way.b").distinct(), what)
    table_ = labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label")), what + "-labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(near, "node").select("node", "label", F.least("label", "near").alias("low"))
        jump = labels.select(F.col("node").alias("low"), F.col("label").alias("next"))
        new = written(step.join(jump, "low", "left").select("node", F.col("label").alias("old"), F.least("low", F.coalesce("next", "low")).alias("label")), what + "-labels")
        removed(table_)
        changed, table_ = new.filter("old <> label").limit(1).count(), new
        labels = new.select("node", "label")
        if not changed:
            removed(both)
            return labels.select("node", F.col("label").alias("component"))


def _spanning(members: DataFrame, group: str, block: int, filled: Callable[[DataFrame], DataFrame], within, what: str) -> DataFrame:
    """Edges (a, b) that connect whatever is linked within a group of members (group, node).

    A group of up to `block` members is one cell. A larger one is dealt at random to blocks, with its least node
    in each of them, so that a group of near copies comes out as one component of as many edges as nodes. Only where
    more components are left are blocks held against blocks: those of a component with over `block` nodes against all
    but its own, and those of all smaller components against each other as well. filled(cells) adds what within needs.
    """
    large = written(members.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("least")).filter(F.col("n") > block).select(group, "least", F.ceil(F.col("n") / block).alias("blocks")), what + "-large")
    one = F.lit(0).cast("long")
    if not large.limit(1).count():
        removed(large)
        return _grouped(filled(members.select(group, "node", one.alias("i"), one.alias("j"))), group, within).drop("j")
    own = lambda blocks: F.pmod(F.xxhash64("node"), blocks)
    at = F.when(F.col("node") == F.col("least"), F.sequence(one, F.col("blocks") - 1)).otherwise(F.array(own(F.coalesce("blocks", F.lit(1)))))
    cells = members.join(large, group, "left").select(group, "node", F.explode(at).alias("i"), F.col("blocks").isNotNull().cast("long").alias("j"))
    first = written(_grouped(filled(cells), group, within), what + "-first")
    held = members.join(large.select(group), group).select(group, "node")
    joined = components(first.filter("j = 1"), what + "-joined")  # the edges of large groups
    placed = written(held.join(joined, "node", "left").select(group, "node", F.coalesce("component", "node").alias("label")), what + "-placed")
    heavy = F.col("n") > block
    labels = written(placed.groupBy(group, "label").agg(F.count(F.lit(1)).alias("n")).select(group, "label", "n", heavy.alias("heavy"), F.when(heavy, F.col("label")).otherwise(0).alias("kind")), what + "-kinds")
    kinds = labels.groupBy(group, "heavy", "kind").agg(F.ceil(F.sum("n") / block).alias("blocks"))
    others = kinds.select(group, F.col("heavy").alias("o_heavy"), F.col("kind").alias("o_kind"), F.col("blocks").alias("o_blocks"))
    apart = ~(F.col("heavy") & F.col("o_heavy") & (F.col("kind") == F.col("o_kind")))
    pairs = written(kinds.join(others, group).filter(apart), what + "-pairs")
    spread = placed.join(labels.drop("n"), [group, "label"]).join(pairs, [group, "heavy", "kind"]).withColumn("other", F.explode(F.sequence(one, F.col("o_blocks") - 1)))
    mine, other = F.xxhash64("heavy", "kind", own(F.col("blocks"))), F.xxhash64("o_heavy", "o_kind", "other")
    cells = spread.select(group, "node", F.least(mine, other).alias("i"), F.greatest(mine, other).alias("j"))
    second = written(_grouped(filled(cells), group, within), what + "-second")
    removed(large, placed, labels, pairs)
    return first.unionByName(second).drop("j")


def _grouped(rows: DataFrame, group: str, within) -> DataFrame:
    """Edges (a, b) that within(frame) gives for each cell, with the cell's j; cells of a partition one after the other."""
    keys = [group, "i", "j"]

    def edges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest: pd.DataFrame | None = None

        def ready(g: pd.DataFrame) -> Iterator[pd.DataFrame]:
            at = g[keys].to_numpy()
            bounds = np.flatnonzero((at[1:] != at[:-1]).any(axis=1)) + 1
            found = [(within(g.iloc[x:y]), at[x, 2]) for x, y in zip([0, *bounds], [*bounds, len(g)], strict=True) if y - x > 1]
            if found:
                yield pd.DataFrame(np.concatenate([e for e, _ in found]), columns=["a", "b"]).assign(j=np.repeat([j for _, j in found], [len(e) for e, _ in found]))

        for b in batches:
            rest = b if rest is None else pd.concat([rest, b])
            if len(rest) > 1:
                at = rest[keys].to_numpy()
                cut = len(rest) - int((at == at[-1]).all(axis=1)[::-1].argmin() or len(rest))
                if cut:
                    yield from ready(rest.iloc[:cut])
                    rest = rest.iloc[cut:]
        if rest is not None and len(rest) > 1:
            yield from ready(rest)

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(edges, "a long, b long, j long")


def _forest(node: np.ndarray, near) -> np.ndarray:
    """Edges that connect what is linked: from the least node of each tree to its others.

    near(i, others) tells which of the others are linked to i. The search is breadth first from the least
    node on: a node is held against those that no tree has reached yet. Buckets with the same nodes so
    give the same edges.
    """
    left, out = np.argsort(node, kind="stable"), []
    while len(left) > 1:
        root, left = left[0], left[1:]
        todo = [root]
        while todo and len(left):
            hit = near(todo.pop(0), left)
            reached = left[hit]
            out += [(node[root], node[x]) for x in reached.tolist()]
            todo += reached.tolist()
            left = left[~hit]
    return np.array(out, np.int64).reshape(-1, 2)


def _close(distance: int):
    def within(g: pd.DataFrame) -> np.ndarray:
        sig = np.frombuffer(b"".join(g["sig"]), np.uint16).reshape(-1, HASHES)
        return _forest(g["node"].to_numpy(), lambda i, others: (sig[others] != sig[i]).sum(axis=1) <= distance)

    return within


def _confirmed(k: int, share: int):
    def within(g: pd.DataFrame) -> np.ndarray:
        g = g.drop_duplicates("node")
        sets = shingle_sets([None if t is None else t.encode() for t in g["text"]], k)
        sizes, both = np.array([len(s) for s in sets]), overlaps(sets)
        linked = 100 * both >= share * (sizes[:, None] + sizes[None, :] - both)
        return _forest(g["node"].to_numpy(), lambda i, others: linked[i, others])

    return within


def near_duplicates(docs: DataFrame, k: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs.

    Words are runs of characters other than white space, A-Z in lower case; a set holds the
    distinct k-word shingles, of a shorter text its whole sequence. Sets with a Jaccard similarity of
    at least `similarity` are linked; a component's id is its least document id, and that
    document is kept. Null and empty texts and texts without words have an empty set and are
    linked with nothing. Repeated rows (equal ids) share a component and are all kept if one is.
    A row with a null id joins its component and is never kept; if its component has no other
    id, component_id is null. An empty table gives no rows. Only the id and the text are read: other columns,
    whatever their names, play no part.
    """
    share = round(100 * similarity)
    distance, keys = plan(similarity)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    made = written(signatures(docs, k, "doc_id", "text"), "near-signatures")
    sets = written(made.filter("n > 0").groupBy("n", "f1", "f2").agg(F.min("doc_id").alias("node"), F.min("sig").alias("sig")).filter("node is not null"), "near-sets")

    def keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                sig = np.frombuffer(b"".join(b["sig"]), np.uint16).reshape(-1, HASHES)
                yield pd.DataFrame({"node": b["node"], "keys": list(_keys(sig, keys))})

    each = lambda nodes: nodes.select("node", "sig").mapInPandas(keyed, "node long, keys array<long>").select("node", F.explode("keys").alias("key"))
    buckets = each(sets).groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1").select("key")
    members = written(each(sets).join(buckets, "key"), "near-members")
    close = _spanning(members, "key", SIGNATURES, lambda cells: cells.join(sets.select("node", "sig"), "node"), _close(distance), "near-close")
    groups = written(components(close, "near-groups"), "near-grouped")
    texts = written(docs.join(groups, docs["doc_id"] == groups["node"]).select("node", "text"), "near-texts")
    families = groups.select(F.col("component").alias("family"), "node")
    links = _spanning(families, "family", TEXTS, lambda cells: cells.join(texts, "node"), _confirmed(k, share), "near-confirmed")
    final = components(links, "near-links")
    of_set = sets.join(final, "node", "left").select("n", "f1", "f2", F.coalesce("component", "node").alias("component_id"))
    alone = F.when((F.col("n") == 0), F.col("doc_id"))
    return made.join(of_set, ["n", "f1", "f2"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", alone).alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def op9_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), k=3, similarity=0.85)
