"""Approximate nearest neighbours by balanced posting lists.

Centroids are fitted on a bounded sample by a k-means whose clusters repel points as they grow,
so the lists come out balanced. They're few enough (MOST_LISTS) for every task, which searches
them best-first over a graph of their neighbours. Each vector is posted to its nearest list and
to the next ones that are nearly as near (boundary vectors: distance at most 1 + SPILL times the
least, up to COPIES lists). A query reads the lists within 1 + PRUNE times the distance of its COPIES-th nearest (its own
vector lies in the ones before, which may be as small as that vector), one in PROBED of all at most but for
the first PROBES, and on beyond that distance until these lists hold enough other vectors for certain. Queries that
still find too few read all lists.

Vectors are compared divided by their largest component: vectors of one direction whatever their lengths then have the very
same quotients, so that their scores are equal to the last bit and ties go by id.

Lists and the queries that read them meet in cells of bounded size: a list with many vectors or
many queries is dealt over several cells by hashes of their ids.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written
from .vectors import best_ids, bounded_sample, distinct_vectors, finite, matrix

#: Vectors that the centroids are fitted on, at most.
SAMPLE = 20_000
#: Vectors wanted for each list, and the most lists.
LIST_SIZE, MOST_LISTS = 200, 4096
COPIES, SPILL = 4, 0.3
PRUNE = 0.5
#: Lists that a query reads at most: PROBES, or one in PROBED where that's more.
PROBES, PROBED = 48, 8
CELL_VECTORS, CELL_QUERIES = 4096, 1024
DEGREE, LONG_LINKS = 20, 6


def directions(rows: np.ndarray) -> np.ndarray:
    """Rows divided by their largest component each: squares neither overflow nor vanish, and parallel rows become equal."""
    return rows / np.abs(rows).max(axis=1, keepdims=True)


def unit(rows: np.ndarray) -> np.ndarray:
    rows = directions(rows)
    return rows / np.sqrt((rows * rows).sum(axis=1))[:, None]


def fit_centroids(sample: np.ndarray, lists: int, rounds: int = 10) -> np.ndarray:
    """Unit centroids of balanced clusters of unit vectors."""
    rng = np.random.default_rng(7)
    cent = sample[np.sort(rng.choice(len(sample), lists, replace=False))].copy()
    fair, load = len(sample) / lists, np.full(lists, len(sample) / lists)
    for _ in range(rounds):
        owner = np.empty(len(sample), np.int64)
        for at in range(0, len(sample), 4096):
            # a cluster above its fair share looks farther away
            owner[at : at + 4096] = np.argmax(sample[at : at + 4096] @ cent.T - 0.05 * np.log(np.maximum(load, 1) / fair), axis=1)
        load = np.bincount(owner, minlength=lists).astype(float)
        total = np.zeros_like(cent)
        np.add.at(total, owner, sample)
        norm = np.sqrt((total * total).sum(axis=1))
        cent = np.where((norm > 1e-9)[:, None], total / np.maximum(norm, 1e-9)[:, None], cent)
    return cent


class CentroidGraph:
    """Centroids with links to their nearest ones, and a few long links that keep it connected."""

    def __init__(self, cent: np.ndarray) -> None:
        self.cent, n = cent, len(cent)
        rng = np.random.default_rng(11)
        near = np.empty((n, min(DEGREE, n)), np.int64)
        for at in range(0, n, 512):
            sims = cent[at : at + 512] @ cent.T
            near[at : at + 512] = np.argsort(-sims, axis=1, kind="stable")[:, : near.shape[1]]
        ring = (np.arange(n)[:, None] + 1) % n
        self.links = np.concatenate([near, ring, rng.integers(0, n, (n, min(LONG_LINKS, n)))], axis=1)
        self.starts = np.unique(np.linspace(0, n - 1, min(n, 8)).astype(np.int64))

    def nearest(self, vec: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """About the `width` nearest centroids of a unit vector, nearest first, and their cosines."""
        seen = np.zeros(len(self.cent), bool)
        seen[self.starts] = True
        sims = self.cent[self.starts] @ vec
        todo = [(-s, int(c)) for s, c in zip(sims, self.starts, strict=True)]
        heapq.heapify(todo)
        best = [(s, -c) for s, c in ((-a, b) for a, b in todo)]
        heapq.heapify(best)
        while len(best) > width:
            heapq.heappop(best)
        while todo:
            s, c = heapq.heappop(todo)
            if len(best) >= width and -s < best[0][0]:
                break
            new = self.links[c]
            new = np.unique(new[~seen[new]])
            if not len(new):
                continue
            seen[new] = True
            sims = self.cent[new] @ vec
            for sim, x in zip(sims.tolist(), new.tolist(), strict=True):
                if len(best) < width:
                    heapq.heappush(best, (sim, -x))
                elif sim > best[0][0]:
                    heapq.heapreplace(best, (sim, -x))
                else:
                    continue
                heapq.heappush(todo, (-sim, x))
        best.sort(reverse=True)
        return np.array([-c for _, c in best]), np.array([s for s, _ in best])


def _select(graph: CentroidGraph, vecs: np.ndarray, width: int, ratio: float, most: int, sizes: np.ndarray | None = None, need: int = 0, base: int = 1) -> list[list[int]]:
    """For each unit vector the lists within `ratio` times the distance of its base-th nearest, at most `most`.

    With the sizes of the lists, those that follow are taken too until all together have `need` vectors.
    """
    out = []
    for v in vecs:
        lists, sims = graph.nearest(v, width)
        dist = np.sqrt(np.maximum(2 - 2 * sims, 0))
        taken = dist <= ratio * dist[min(base, len(dist)) - 1] + 1e-12
        if sizes is not None:
            taken |= np.cumsum(sizes[lists]) - sizes[lists] < need
        out.append(lists[taken][:most].tolist())
    return out


def nearest_neighbours(rows: DataFrame, is_query, k: int = 5) -> DataFrame:
    """rows (id, vec) to query_id, rank, vec_id, score for the rows where is_query(id) holds.

    Score: the cosine in double precision. Null, empty and zero vectors and vectors with a null or
    non-finite component take no part. Vectors shorter than the longest are continued with zeros.
    Ties go to the smaller id; repeated rows are candidates of their own. With fewer than k other
    vectors, all are returned. An empty table gives no rows. Only id and vec are read: other columns, whatever
    their names, play no part.
    """
    spark = rows.sparkSession
    rows = rows.select("id", F.transform("vec", lambda x: x.cast("double")).alias("vec"))
    rows = rows.filter(finite(F.col("vec")) & F.exists("vec", lambda x: x != 0))
    reps = written(distinct_vectors(rows, k + 1), "ann-vectors")
    n, width = reps.agg(F.count(F.lit(1)), F.max(F.size("vec"))).first()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sample = unit(matrix(bounded_sample(reps, SAMPLE)["vec"], width))
    lists = int(min(MOST_LISTS, len(sample), max(1, n // LIST_SIZE)))
    shared = spark.sparkContext.broadcast(CentroidGraph(fit_centroids(sample, lists)))
    probes = min(lists, max(PROBES, lists // PROBED))

    def choose(width_: int, ratio: float, most: int, sizes: np.ndarray | None = None, need: int = 0, base: int = 1):
        def chosen(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                if len(b):
                    yield b.assign(lists=_select(shared.value, unit(matrix(b["vec"], width)), width_, ratio, most, sizes, need, base))

        return chosen

    postings = reps.mapInPandas(choose(4 * COPIES, 1 + SPILL, COPIES), "rep long, ids array<long>, vec array<double>, lists array<long>")
    postings = written(postings.withColumn("list", F.explode("lists")).drop("lists"), "ann-postings")
    sizes = np.zeros(lists, np.int64)
    for r in postings.groupBy("list").agg(F.count(F.lit(1)).alias("n")).collect():  # a row for each list
        sizes[r["list"]] = r["n"]
    asked = rows.filter(is_query(F.col("id"))).select("id", "vec")
    queries = asked.mapInPandas(choose(probes, 1 + PRUNE, probes, sizes, COPIES * (k + 1), COPIES), "id long, vec array<double>, lists array<long>")
    queries = written(queries.withColumn("list", F.explode("lists")).drop("lists"), "ann-queries")
    found = written(_scanned(postings, queries, width, k), "ann-found")
    best = best_ids(found, k)
    others = rows.count() - 1
    short = best.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min(k, others))
    short = written(asked.join(short, asked["id"] == short["query_id"], "left_anti").withColumn("list", F.explode(F.lit(np.flatnonzero(sizes).tolist()).cast("array<long>"))), "ann-short")
    if others > 0 and short.limit(1).count():
        best = best_ids(found.unionByName(_scanned(postings, short, width, k)), k)
    return best


def _scanned(postings: DataFrame, queries: DataFrame, width: int, k: int) -> DataFrame:
    """query_id, rep, ids, score of the best vectors in each list that a query reads."""
    cells = (
        postings.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / CELL_VECTORS).cast("int").alias("subs"))
        .join(queries.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / CELL_QUERIES).cast("int").alias("blocks")), "list")
    )  # at most MOST_LISTS rows
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    dealt = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    left = postings.join(F.broadcast(cells), "list").withColumn("sub", dealt("rep", "subs")).withColumn("block", upto("blocks"))
    right = queries.join(F.broadcast(cells), "list").withColumn("block", dealt("id", "blocks")).withColumn("sub", upto("subs"))

    def scan(post: pd.DataFrame, query: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"query_id": pd.Series(dtype="int64"), "rep": pd.Series(dtype="int64"), "ids": pd.Series(dtype=object), "score": pd.Series(dtype="float64")})
        if not len(post) or not len(query):
            return none
        p, q = directions(matrix(post["vec"], width)), directions(matrix(query["vec"], width))
        pn, qn = np.sqrt((p * p).sum(axis=1)), np.sqrt((q * q).sum(axis=1))
        sims = (q / qn[:, None]) @ (p / pn[:, None]).T
        keep = min(k + 1, len(p))
        least = np.partition(sims, len(p) - keep, axis=1)[:, len(p) - keep] - 1e-12
        reps, asked, found, scores = post["rep"].to_numpy(), [], [], []
        for i in range(len(q)):
            near = np.flatnonzero(sims[i] >= least[i])
            score = (q[i] * p[near]).sum(axis=1) / (qn[i] * pn[near])  # the same sum for a pair, whatever the block
            first = np.lexsort((reps[near], -score))[:keep]  # of tied vectors those with the least ids: no other can be among the k best
            asked.append(np.full(len(first), i))
            found.append(near[first])
            scores.append(score[first])
        i, j = np.concatenate(asked), np.concatenate(found)
        return pd.DataFrame({"query_id": query["id"].to_numpy()[i], "rep": reps[j], "ids": post["ids"].to_numpy()[j], "score": np.concatenate(scores)})

    return (
        left.select("list", "sub", "block", "rep", "ids", "vec").groupBy("list", "sub", "block")
        .cogroup(right.select("list", "sub", "block", "id", "vec").groupBy("list", "sub", "block"))
        .applyInPandas(scan, "query_id long, rep long, ids array<long>, score double")
    )


def op2_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    return nearest_neighbours(rows, lambda i: i % 50 == 0)
