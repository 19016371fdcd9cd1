"""Approximate nearest neighbours by balanced posting lists.

Centroids of balanced clusters are fitted on a bounded sample and kept, with a graph over
them, in the memory of every worker.  Each vector goes to the posting list of its nearest
centroid, and near a border also to the lists of other close centroids; a query reads all
lists whose centroid is not much farther than its nearest one.  Lists of any length are cut
into blocks, and so are the queries of a list; each block of the one meets each block of the
other, so that no vector is left out and no task holds more than two blocks.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarn.llm.common import materialize, small_batches

#: Vectors the centroids are fitted on at most (in expectation): a bounded sample by a hash of the id.
MAX_SAMPLE = 20_000
#: Vectors in a posting list on average, and centroids at most.
LIST_SIZE, MAX_LISTS = 1_000, 4_096
#: A vector is replicated to lists whose centroid is at most so many times as far as its nearest, up to COPIES.
BORDER_RATIO, COPIES = 1.10, 2
#: A query reads lists up to so many times as far as its nearest centroid.
QUERY_RATIO = 1.15
#: Neighbours of a centroid in the graph, and the breadth at which a search for lists starts.
DEGREE, BREADTH = 16, 16
#: Rows of a posting list, and queries of it, that one task holds.
BLOCK = 8_192


def unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def squared_distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x**2).sum(1)[:, None] - 2 * x @ c.T + (c**2).sum(1), 0)


def balanced_centroids(x: np.ndarray, lists: int, seed: int = 7) -> np.ndarray:
    """Centroids of about ``lists`` clusters: each is halved along its main spread until small enough.

    Halving at the median keeps clusters equally large; a few rounds of averaging then move
    the centroids to the middle of what lies nearest to them.
    """
    if not len(x):
        return np.empty((0, 0))
    rng = np.random.default_rng(seed)
    most = max(1, -(-len(x) // max(1, lists)))
    todo, done = [np.arange(len(x))], []
    while todo:
        own = todo.pop()
        if len(own) <= most or (x[own] == x[own[0]]).all():
            done.append(own)
            continue
        centred = x[own] - x[own].mean(axis=0)
        axis = rng.normal(size=x.shape[1])
        for _ in range(8):
            axis = centred.T @ (centred @ axis)
            axis /= np.linalg.norm(axis) or 1
        order = np.argsort(centred @ axis, kind="stable")
        todo += [own[order[: len(own) // 2]], own[order[len(own) // 2 :]]]
    centroids = np.array([x[o].mean(axis=0) for o in done])
    for _ in range(4):
        nearest = np.concatenate(
            [squared_distances(x[i : i + 4096], centroids).argmin(1) for i in range(0, len(x), 4096)]
        )
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, x)
        sizes = np.bincount(nearest, minlength=len(centroids))
        centroids[sizes > 0] = sums[sizes > 0] / sizes[sizes > 0, None]
    return np.unique(centroids, axis=0)


class CentroidGraph:
    """Greedy best-first search for near centroids over a graph of near neighbours."""

    def __init__(self, centroids: np.ndarray, degree: int = DEGREE):
        self.centroids = centroids
        n = len(centroids)
        order = np.argsort(squared_distances(centroids, centroids), axis=1)[:, 1 : degree + 1] if n > 1 else []
        edges: list[set[int]] = [set(map(int, o)) for o in order] or [set() for _ in range(n)]
        for i, own in enumerate([*map(list, edges)]):
            for j in own:
                edges[j].add(i)
            edges[i].add((i + 1) % n)  # a ring keeps the graph in one piece
        self.edges = [np.array(sorted(e - {i}), dtype=np.int64) for i, e in enumerate(edges)]
        step = max(1, n // 32)
        self.entries = np.arange(0, n, step)

    def search(self, x: np.ndarray, breadth: int = BREADTH) -> tuple[np.ndarray, np.ndarray]:
        """Distances (squared, increasing) and numbers of up to ``breadth`` near centroids."""
        c = self.centroids
        first = self.entries
        d = ((c[first] - x) ** 2).sum(1)
        seen = np.zeros(len(c), dtype=bool)
        seen[first] = True
        frontier = [(float(a), int(b)) for a, b in zip(d, first, strict=True)]
        heapq.heapify(frontier)
        best = [(-a, b) for a, b in frontier]
        heapq.heapify(best)
        while len(best) > breadth:
            heapq.heappop(best)
        while frontier:
            near, at = heapq.heappop(frontier)
            if len(best) >= breadth and near > -best[0][0]:
                break
            fresh = self.edges[at]
            fresh = fresh[~seen[fresh]]
            if not len(fresh):
                continue
            seen[fresh] = True
            for a, b in zip(((c[fresh] - x) ** 2).sum(1).tolist(), fresh.tolist(), strict=True):
                if len(best) < breadth:
                    heapq.heappush(best, (-a, b))
                elif a < -best[0][0]:
                    heapq.heapreplace(best, (-a, b))
                else:
                    continue
                heapq.heappush(frontier, (a, b))
        best = sorted((-a, b) for a, b in best)
        return np.array([a for a, _ in best]), np.array([b for _, b in best], dtype=np.int64)

    def lists(self, x: np.ndarray, ratio: float, most: int | None = None) -> np.ndarray:
        """Lists whose centroid is at most ``ratio`` times as far as the nearest."""
        breadth = BREADTH
        while True:
            d, at = self.search(x, breadth)
            keep = at[np.sqrt(d) <= ratio * np.sqrt(d[0]) + 1e-12][:most]
            if len(keep) < len(at) or len(at) >= len(self.centroids) or (most and len(keep) >= most):
                return keep
            breadth *= 4  # every list within the ratio is wanted


def common_length(vectors: DataFrame) -> tuple[int, int]:
    """The commonest length of ``vectors`` (vec_id, vec), the greatest of equally common ones, and how many have it."""
    sizes = vectors.groupBy(F.size("vec").alias("size")).agg(F.count("*").alias("n"))
    first = sizes.orderBy(F.desc("n"), F.desc("size")).first()
    return (first["size"], first["n"]) if first else (0, 0)


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id and vec: rows whose vector has only finite components and is not zero."""
    v = F.col(vector_col)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = F.exists(v, lambda x: x != 0)
    rows = vectors.where(F.coalesce(fine & some, F.lit(False)))
    return rows.select(F.col(id_col).alias("vec_id"), v.cast("array<double>").alias("vec"))


def fit(vectors: DataFrame, rows: int) -> CentroidGraph:
    """Centroids and their graph from a bounded sample of ``vectors`` (vec_id, vec)."""
    share = min(1.0, MAX_SAMPLE / max(1, rows))
    draw = F.pmod(F.xxhash64("vec_id", "vec", F.lit(9)), F.lit(1 << 30)) < int(share * (1 << 30))
    sample = sorted((r.vec for r in vectors.where(draw).select("vec").collect()))
    x = np.array(sample, dtype=np.float64)
    lists = int(min(MAX_LISTS, max(1, rows / LIST_SIZE)))
    return CentroidGraph(balanced_centroids(unit(x), lists) if len(x) else np.empty((0, 0)))


def posting_rows(vectors: DataFrame, graph: CentroidGraph, ratio: float, most: int | None) -> DataFrame:
    """list, vec_id and vec: each vector once for every list it belongs to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = unit(np.array(batch.column(1).to_pylist(), dtype=np.float64).reshape(batch.num_rows, -1))
            found = [graph.lists(v, ratio, most) for v in x]
            at = np.repeat(np.arange(len(x)), [len(f) for f in found])
            numbers = np.concatenate([np.empty(0, np.int64), *found]).astype(np.int64)
            taken = batch.take(pa.array(at))
            yield pa.RecordBatch.from_arrays([pa.array(numbers), *taken.columns], names=["list", "vec_id", "vec"])

    return vectors.mapInArrow(run, "list long, vec_id long, vec array<double>")


def cosines(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Cosines of row pairs in double precision, in an order of additions that only their values fix."""
    return (q * v).sum(axis=1) / (np.sqrt((q * q).sum(axis=1)) * np.sqrt((v * v).sum(axis=1)))


def best_pairs(q_ids: np.ndarray, q: np.ndarray, v_ids: np.ndarray, v: np.ndarray, k: int) -> list[tuple]:
    """For each query its ``k`` nearest of ``v`` by cosine, ties to smaller ids, itself left out."""
    out = []
    qu, vu = unit(q), unit(v)
    repeats = int(np.unique(v_ids, return_counts=True)[1].max())
    for start in range(0, len(q), 256):
        rough = qu[start : start + 256] @ vu.T
        rough[q_ids[start : start + 256, None] == v_ids] = -2
        top = min(k * repeats, rough.shape[1])
        border = -np.partition(-rough, top - 1, axis=1)[:, top - 1] - 1e-9
        for i, row in enumerate(rough):
            at = np.flatnonzero((row >= border[i]) & (row > -1.5))
            exact = cosines(np.broadcast_to(q[start + i], (len(at), q.shape[1])), v[at])
            taken: dict[int, float] = {}
            for j in np.lexsort((v_ids[at], -exact)):
                taken.setdefault(int(v_ids[at[j]]), float(exact[j]))
                if len(taken) == k:
                    break
            out += [(int(q_ids[start + i]), *pair) for pair in taken.items()]
    return out


def nearest(
    vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """query_id, rank, vec_id and score: each query's ``k`` nearest of ``vectors`` found, by cosine.

    Nearest come first, ties go to the smaller vec_id.  Null, zero and non-finite vectors take
    no part, on either side, nor do those of another length than the commonest among
    ``vectors`` (the greatest of equally common ones).  Rows that repeat a vec_id count once,
    with their best score.  Fewer candidates than ``k`` give fewer rows; an empty table gives
    none; other columns are not looked at.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    vectors, queries = usable(vectors, id_col, vector_col), usable(queries, id_col, vector_col)
    length, rows = common_length(vectors)
    vectors, queries = vectors.where(F.size("vec") == length), queries.where(F.size("vec") == length)
    graph = fit(vectors, rows)
    schema = "query_id long, vec_id long, score double"
    if not len(graph.centroids):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    posted = posting_rows(vectors, graph, BORDER_RATIO, COPIES)
    asked = materialize(posting_rows(queries, graph, QUERY_RATIO, None), "asked")
    lengths = posted.groupBy("list").agg(F.count("*").alias("n")).join(
        asked.groupBy("list").agg(F.count("*").alias("asked")), "list"
    )
    blocks = (F.ceil(F.col(c) / BLOCK).cast("long").alias(b) for c, b in (("n", "blocks"), ("asked", "ask_blocks")))
    # One row for each list that a query reads: MAX_LISTS of them at most.
    lengths = F.broadcast(materialize(lengths, "lengths").select("list", *blocks))
    row = F.xxhash64("vec_id", "vec")

    def every(count: str) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.col(count) - 1))

    posted = posted.join(lengths, "list").select(
        "list", F.pmod(row, F.col("blocks")).alias("block"), every("ask_blocks").alias("ask_block"), "vec_id", "vec"
    )
    asked = asked.join(lengths, "list").select(
        "list", every("blocks").alias("block"), F.pmod(row, F.col("ask_blocks")).alias("ask_block"), "vec_id", "vec"
    )

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(left) and len(right):
            found = best_pairs(
                left["vec_id"].to_numpy(), np.vstack(left["vec"].to_numpy()),
                right["vec_id"].to_numpy(), np.vstack(right["vec"].to_numpy()), k,
            )
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"])

    keys = ("list", "block", "ask_block")
    pairs = asked.groupBy(*keys).cogroup(posted.groupBy(*keys)).applyInPandas(search, schema)
    pairs = pairs.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score"
    )
