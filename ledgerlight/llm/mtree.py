"""Exact top-k inner product search by M-trees, searched best-first.

Largest inner product becomes least distance by one more coordinate: x goes to
(x, sqrt(M^2 - |x|^2)) with M the largest norm, a query q to (q, 0), and then
|q - x|^2 = |q|^2 + M^2 - 2 <q, x>.

The space is cut into regions around pivots chosen from a bounded sample; the vectors of a
region are dealt over trees of bounded size. A tree is a table of pages. An entry of an inner
page is a routing object with its covering radius and its distance to the routing object above;
an entry of a leaf page is a vector with that distance. A search holds the k-th best score of
each query so far; it opens pages in the order of their least possible distance and leaves out
pages and entries that the triangle inequality with the stored distances excludes, so that their
own distances are never computed. Queries run through a tree in blocks, each with its own bound.

The first round searches only each query's home region; its k-th best score then bounds, in the
second round, which other regions it has to visit at all.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written
from .vectors import best_ids, bounded_sample, distinct_vectors, finite, matrix

SAMPLE = 8192
REGION_SIZE, MOST_REGIONS = 4096, 1024
TREE_VECTORS, PAGE, FANOUT = 8192, 128, 16
BLOCK_QUERIES = 512
#: Slack of the bounds against rounding, as a share of the largest distance.
SLACK = 1e-7
#: Sums below these are exact in doubles and in longs.
EXACT, LONG = float(1 << 53), float(1 << 62)

PAGES = "tree long, page int, leaf boolean, vectors binary, radius binary, to_parent binary, child binary, ids array<array<long>>"


def lifted(rows: np.ndarray, norm2: float) -> np.ndarray:
    """Rows with the coordinate that gives all of them the norm of the largest."""
    rest = np.sqrt(np.maximum(norm2 - (rows * rows).sum(axis=1), 0))
    return np.concatenate([rows, rest[:, None]], axis=1)


def _apart(rows: np.ndarray, point: np.ndarray) -> np.ndarray:
    diff = rows - point
    return np.sqrt((diff * diff).sum(axis=1))


def build_tree(tree: int, vecs: np.ndarray, ids: list) -> list[dict]:
    """Pages of an M-tree over the lifted vectors, the root first."""
    pages: list[dict] = []

    def page_of(members: np.ndarray, parent: np.ndarray | None) -> int:
        number = len(pages)
        pages.append({})
        if len(members) <= PAGE:
            rows = vecs[members]
            pages[number] = _page(tree, number, True, rows, np.zeros(0), _apart(rows, parent) if parent is not None else np.zeros(len(rows)), np.zeros(0, np.int64), [ids[m] for m in members])
            return number
        step = len(members) / FANOUT
        routers = vecs[members[(np.arange(FANOUT) * step).astype(np.int64)]]
        d2 = (routers * routers).sum(axis=1) - 2 * vecs[members] @ routers.T
        owner = np.argmin(d2, axis=1)
        counts = np.bincount(owner, minlength=FANOUT)
        if counts.max() > 0.9 * len(members):  # routers that tell nothing apart: an even cut
            owner = np.arange(len(members)) * FANOUT // len(members)
        used = [r for r in range(FANOUT) if (owner == r).any()]
        groups = [members[owner == r] for r in used]
        rows = routers[used]
        radius = np.array([_apart(vecs[g], rows[i]).max() for i, g in enumerate(groups)])
        above = _apart(rows, parent) if parent is not None else np.zeros(len(rows))
        child = np.array([page_of(g, rows[i]) for i, g in enumerate(groups)], np.int64)
        pages[number] = _page(tree, number, False, rows, radius, above, child, [])
        return number

    page_of(np.arange(len(vecs)), None)
    return pages


def _page(tree, number, leaf, rows, radius, above, child, ids) -> dict:
    return {"tree": tree, "page": number, "leaf": leaf, "vectors": np.ascontiguousarray(rows).tobytes(), "radius": radius.tobytes(),
            "to_parent": above.tobytes(), "child": child.tobytes(), "ids": ids}


def products(a: np.ndarray, b: np.ndarray, bits: int, norm2: float) -> np.ndarray:
    """Exact inner products of rows of integers, which are held divided by 2^bits; as longs where doubles can't hold them.

    norm2: the largest square of a norm, as held. A product beyond a long becomes the nearest long.
    """
    if not bits and norm2 < EXACT:
        return a @ b.T
    a, b = np.ldexp(a, bits), np.ldexp(b, bits)
    if np.ldexp(norm2, 2 * bits) < LONG:
        return a.astype(np.int64) @ b.astype(np.int64).T
    whole = np.array([[int(x) for x in r] for r in a], object) @ np.array([[int(x) for x in r] for r in b], object).T
    return np.clip(whole, LEAST, -LEAST - 1).astype(np.int64)


#: The score of an empty place among longs.
LEAST = -(1 << 63)


class Best:
    """The `keep` best (score, then least rep) of each query of a block."""

    def __init__(self, n: int, keep: int, floor: np.ndarray) -> None:
        self.keep, self.floor = keep, floor
        none = -np.inf if floor.dtype.kind == "f" else LEAST
        self.score, self.rep, self.ids = np.full((n, keep), none, floor.dtype), np.full((n, keep), np.iinfo(np.int64).max), np.full((n, keep), None, object)

    def bound(self) -> np.ndarray:
        return np.maximum(self.score[:, -1], self.floor)

    def merge(self, who: np.ndarray, scores: np.ndarray, reps: np.ndarray, ids: np.ndarray) -> None:
        gain = (scores >= self.bound()[who][:, None]).any(axis=1)
        who, scores = who[gain], scores[gain]
        if not len(who):
            return
        score = np.concatenate([self.score[who], scores], axis=1)
        rep = np.concatenate([self.rep[who], np.broadcast_to(reps, scores.shape)], axis=1)
        which = np.concatenate([self.ids[who], np.broadcast_to(ids, scores.shape)], axis=1)
        order = np.lexsort((rep, -score if score.dtype.kind == "f" else ~score), axis=1)[:, : self.keep]
        take = lambda a: np.take_along_axis(a, order, axis=1)
        self.score[who], self.rep[who], self.ids[who] = take(score), take(rep), take(which)


def search(pages: dict[int, dict], queries: np.ndarray, norm2: float, keep: int, floor: np.ndarray, bits: int = 0) -> Best:
    """Best-first search of one tree by a block of queries (not lifted).

    floor: what a score has to reach, doubles where those hold all products and longs elsewhere. With bits, pages, queries
    and norm2 are of vectors divided by 2^bits.
    """
    best, width = Best(len(queries), keep, floor), queries.shape[1] + 1
    q = np.concatenate([queries, np.zeros((len(queries), 1))], axis=1)
    q2 = (q * q).sum(axis=1)
    far = np.sqrt(q2.max(initial=0) + norm2) + np.sqrt(norm2)
    slack = SLACK * far + 1e-12

    def limit(who: np.ndarray) -> np.ndarray:
        """The largest distance at which a vector still matters to each query."""
        b = best.bound()[who]
        b = np.where(b == LEAST, -np.inf, np.ldexp(b.astype(float), -2 * bits)) if b.dtype.kind == "i" else b
        return np.where(np.isinf(b), np.inf, np.sqrt(np.maximum(q2[who] + norm2 - 2 * np.where(np.isinf(b), 0, b), 0))) + slack

    everyone = np.arange(len(queries))
    todo: list[tuple[float, int, np.ndarray, np.ndarray | None]] = [(0.0, 0, np.zeros(len(queries)), None)]
    while todo:
        _, number, least, to_parent = heapq.heappop(todo)
        who = everyone[least <= limit(everyone)]
        if not len(who):
            continue
        page = pages[number]
        rows = np.frombuffer(page["vectors"]).reshape(-1, width)
        above = np.frombuffer(page["to_parent"])
        if page["leaf"]:
            if to_parent is not None:  # |d(q, parent) - d(x, parent)| <= d(q, x)
                near = (np.abs(to_parent[who][:, None] - above[None, :]) <= limit(who)[:, None]).any(axis=0)
            else:
                near = np.ones(len(rows), bool)
            if near.any():
                ids = [page["ids"][i] for i in np.flatnonzero(near)]
                holder = np.empty(len(ids), object)
                holder[:] = ids
                best.merge(who, products(queries[who], rows[near, :-1], bits, norm2), np.array([x[0] for x in ids], np.int64), holder)
            continue
        radius, child = np.frombuffer(page["radius"]), np.frombuffer(page["child"], np.int64)
        if to_parent is not None:
            near = (np.abs(to_parent[who][:, None] - above[None, :]) - radius[None, :] <= limit(who)[:, None]).any(axis=0)
        else:
            near = np.ones(len(rows), bool)
        kept = np.flatnonzero(near)
        if not len(kept):
            continue
        dist = np.sqrt(np.maximum(q2[who][:, None] + (rows[kept] ** 2).sum(axis=1)[None, :] - 2 * q[who] @ rows[kept].T, 0))
        for i, e in enumerate(kept.tolist()):
            low, router = np.full(len(queries), np.inf), np.zeros(len(queries))
            low[who], router[who] = np.maximum(dist[:, i] - radius[e] - slack, 0), dist[:, i]
            heapq.heappush(todo, (float(low.min()), int(child[e]), low, router))
    return best


def top_products(rows: DataFrame, is_query, k: int = 5, scale: int = 256) -> DataFrame:
    """rows (id, vec) to query_id, rank, vec_id, score for the rows where is_query(id) holds.

    Components become floor(scale * x); the score is the integer inner product. Null and empty
    vectors and those with a null or non-finite component take no part; a zero vector does.
    Vectors shorter than the longest are continued with zeros. Ties go to the smaller id; repeated
    rows are candidates of their own. With fewer than k other vectors, all are returned. Products are exact
    whatever their size; one beyond a long counts as the nearest long. An empty table gives no rows. Only id and vec
    are read: other columns, whatever their names, play no part.
    """
    spark = rows.sparkSession
    rows = rows.filter(finite(F.col("vec")))
    largest = F.lit(float(np.finfo(float).max))

    def whole(y: Column) -> Column:
        """floor, of which Spark gives a long; doubles beyond 2^53 are whole already."""
        return F.when(F.abs(y) < EXACT, F.floor(y).cast("double")).otherwise(F.greatest(F.least(y, largest), -largest))

    rows = rows.select("id", F.transform("vec", lambda x: whole(x.cast("double") * scale)).alias("vec"))
    reps = written(distinct_vectors(rows, k + 1), "mtree-vectors")
    square = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x)
    n, width, norm2, top = reps.agg(F.count(F.lit(1)), F.max(F.size("vec")), F.max(square), F.max(F.array_max(F.transform("vec", F.abs)))).first()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    bits = 0
    if norm2 >= EXACT:  # the search then runs over vectors that a power of two divides, which loses no digit
        bits = max(0, int(np.frexp(top)[1]) - 20)
        smaller = F.transform("vec", lambda x: x * F.lit(2.0**-bits))
        reps, rows = reps.withColumn("vec", smaller), rows.withColumn("vec", smaller)
        norm2 = reps.agg(F.max(square)).first()[0]
    exact = not bits and norm2 < EXACT
    regions = int(min(MOST_REGIONS, max(1, n // REGION_SIZE)))
    sample = lifted(matrix(bounded_sample(reps, SAMPLE)["vec"], width), norm2)
    pivots = _spread(sample, regions)
    shared = spark.sparkContext.broadcast(pivots)

    def locate(lift: bool):
        def located(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                if len(b):
                    v = matrix(b["vec"], width)
                    v = lifted(v, norm2) if lift else np.concatenate([v, np.zeros((len(v), 1))], axis=1)
                    dist = np.sqrt(np.maximum((v * v).sum(axis=1)[:, None] + (shared.value**2).sum(axis=1)[None, :] - 2 * v @ shared.value.T, 0))
                    home = np.argmin(dist, axis=1)
                    yield b.assign(region=home, dist=dist[np.arange(len(v)), home]) if lift else b.assign(region=home, dists=list(dist))

        return located

    placed = written(reps.mapInPandas(locate(True), "rep long, ids array<long>, vec array<double>, region long, dist double"), "mtree-regions")
    stats = placed.groupBy("region").agg(F.max("dist").alias("radius"), F.ceil(F.count(F.lit(1)) / TREE_VECTORS).cast("int").alias("subs")).toPandas()  # at most MOST_REGIONS
    radius, subs = dict(zip(stats["region"], stats["radius"], strict=True)), spark.createDataFrame(stats[["region", "subs"]])

    def grown(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("rep")
        return pd.DataFrame(build_tree(int(g["tree"].iloc[0]), lifted(matrix(g["vec"], width), norm2), [list(map(int, x)) for x in g["ids"]]))

    tree = (F.col("region") * (1 << 24) + F.pmod(F.xxhash64("rep"), F.col("subs"))).alias("tree")
    pages = written(placed.join(F.broadcast(subs), "region").select(tree, "rep", "ids", "vec").groupBy("tree").applyInPandas(grown, PAGES), "mtree-pages")
    queries = written(rows.filter(is_query(F.col("id"))).mapInPandas(locate(False), "id long, vec array<double>, region long, dists array<double>"), "mtree-queries")

    def visit(asked: DataFrame) -> DataFrame:
        """asked (id, vec, floor, region): the search of each asked region's trees."""
        blocks = asked.groupBy("region").agg(F.ceil(F.count(F.lit(1)) / BLOCK_QUERIES).cast("int").alias("blocks"))  # at most MOST_REGIONS rows
        cells = F.broadcast(subs.join(blocks, "region"))
        q = asked.join(cells, "region").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
        q = q.select("id", "vec", "floor", "block", F.explode(F.sequence(F.col("region") * (1 << 24), F.col("region") * (1 << 24) + F.col("subs") - 1)).alias("tree"))
        p = pages.withColumn("region", F.shiftright("tree", 24)).join(cells, "region").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))

        def run(page: pd.DataFrame, query: pd.DataFrame) -> pd.DataFrame:
            out = {"query_id": [], "rep": [], "ids": [], "score": []}
            if len(page) and len(query):
                query = query.sort_values("id")
                floor = query["floor"].to_numpy(float, na_value=-np.inf) if exact else query["floor"].fillna(LEAST).to_numpy(np.int64)
                best = search({x["page"]: x for x in page.to_dict("records")}, matrix(query["vec"], width), norm2, k + 1, floor, bits)
                some = best.rep != np.iinfo(np.int64).max
                out = {"query_id": np.repeat(query["id"].to_numpy(), k + 1)[some.ravel()], "rep": best.rep[some], "ids": best.ids[some], "score": best.score[some].astype(np.int64)}
            return pd.DataFrame(out)

        keys = ["tree", "block"]
        return q.select(*keys, "id", "vec", "floor").groupBy(*keys).cogroup(p.drop("region", "subs", "blocks").groupBy(*keys)).applyInPandas(
            lambda a, b: run(b, a), "query_id long, rep long, ids array<long>, score long"
        )

    home = written(visit(queries.select("id", "vec", F.lit(None).cast("long").alias("floor"), "region")), "mtree-home")
    kth = home.groupBy(F.col("query_id").alias("id")).agg(F.sort_array(F.collect_list("score"), asc=False).alias("s")).select(
        "id", F.when(F.size("s") > k, F.element_at("s", k + 1)).otherwise(F.lit(None)).cast("long").alias("floor")
    )  # a home region gives k + 1 scores for each of its trees
    radii = [float(radius.get(r, -1.0)) for r in range(regions)]

    def others(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        r, seen = np.array(radii), np.array(radii) >= 0
        for b in batches:
            if not len(b):
                continue
            v = matrix(b["vec"], width)
            f = np.ldexp(b["floor"].astype("Float64").to_numpy(dtype=float, na_value=-np.inf), -2 * bits)
            at = np.sqrt(np.maximum((v * v).sum(axis=1) + norm2 - 2 * np.where(np.isinf(f), 0, f), 0))
            at = np.where(np.isinf(f), np.inf, at + SLACK * (at + np.sqrt(norm2)) + 1e-12)
            reach = (np.stack(b["dists"].to_numpy()) - r[None, :] <= at[:, None]) & seen[None, :]
            reach[np.arange(len(b)), b["region"].to_numpy()] = False
            i, j = np.nonzero(reach)
            yield pd.DataFrame({"id": b["id"].to_numpy()[i], "floor": b["floor"].array[i], "region": j})

    # ids and bounds alone are written; a vector goes only to the trees that its query visits
    asked = queries.join(kth, "id", "left").select("id", "vec", "floor", "region", "dists").mapInPandas(others, "id long, floor long, region long")
    asked = written(asked, "mtree-asked").join(queries.select("id", "vec").dropDuplicates(["id"]), "id")
    found = home.unionByName(visit(asked))
    return best_ids(found, k)


def _spread(sample: np.ndarray, n: int) -> np.ndarray:
    """n pivots: the means of a few rounds of k-means over the sample."""
    cent = sample[(np.arange(n) * (len(sample) / n)).astype(np.int64)].copy()
    for _ in range(5):
        owner = np.argmin((cent * cent).sum(axis=1)[None, :] - 2 * sample @ cent.T, axis=1)
        for c in range(n):
            if (owner == c).any():
                cent[c] = sample[owner == c].mean(axis=0)
    return cent


def op8_mtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    return top_products(rows, lambda i: i % 50 == 0)
