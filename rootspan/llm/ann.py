"""Approximate nearest neighbours over balanced posting lists.

Build. Centroids come from balanced hierarchical k-means over at most ``SAMPLE`` vectors (the ones with the
smallest hash of their id): every split has clusters of bounded size. There are about half the square root of
the number of vectors of them, ``MOST_LISTS`` at most. They are joined to their nearest centroids by a graph
that is held in memory and searched for every vector. A vector goes to the posting lists of its nearest
centroid and of those not more than ``BOUNDARY`` times as far, ``COPIES`` lists at most, so that vectors near
a boundary are found from either side. Every vector is indexed.

Search. The same graph gives a query's centroids; it takes the lists whose centroids are not more than
``PRUNE`` times as far as the nearest, and ``LEAST_LISTS`` in any case (a query close to a dense spot would take
too few). Lists and the queries that take them meet in cells of bounded size:
a list is dealt into blocks of about ``BLOCK`` vectors by a hash of the id, however many equal vectors it
holds, and its queries into blocks of ``QUERY_BLOCK``. Each cell computes distances by matrix product, then
exactly, in double precision from the original components, for all that may be among the nearest, and
passes on each query's ``k`` best ids, each with its smallest distance, which a ranking per query merges.

Defined results: vectors that are null, zero, of another length than most, or hold null or non-finite
components take no part, nor do null ids; equal distances go to the smaller id; an id that occurs twice is
returned once, with its smallest distance; a query never returns its own id; a query that finds fewer than ``k`` ids
in its lists searches all lists, so that ``k`` are returned, or all if there are fewer; without vectors there are no
rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rootspan.llm.tasks import lean
from rootspan.scratch import settle, settle_counted

SAMPLE = 50_000
MOST_LISTS = 8192
COPIES = 4
BOUNDARY = 1.1
PRUNE = 1.2
LEAST_LISTS = 8
DEGREE = 24
BLOCK = 4096
QUERY_BLOCK = 1024


def balanced(x: np.ndarray, lists: int, seed: int = 5) -> np.ndarray:
    """Centroids of about ``lists`` clusters of nearly equal size, by repeated balanced splits."""
    r, out, stack = np.random.default_rng(seed), [], [(np.arange(len(x)), lists)]
    while stack:
        at, want = stack.pop()
        if want <= 1 or len(at) <= want:
            out.append(x[at].mean(0))
            continue
        k = min(8, want)
        c = x[at][r.choice(len(at), k, replace=False)]
        room = -(-len(at) // k)
        for _ in range(8):
            d = ((x[at] ** 2).sum(1)[:, None] + (c**2).sum(1)[None] - 2 * x[at] @ c.T) if len(at) else np.zeros((0, k))
            order = np.argsort(d, 1)
            best = np.sort(d, 1)
            left, of = [room] * k, np.empty(len(at), np.int64)
            for i in np.argsort(best[:, 0] - best[:, -1], kind="stable").tolist():  # those that lose most choose first
                for j in order[i].tolist():
                    if left[j]:
                        left[j] -= 1
                        of[i] = j
                        break
            c = np.stack([x[at][of == j].mean(0) if (of == j).any() else c[j] for j in range(k)])
        share = [want // k + (j < want % k) for j in range(k)]
        stack += [(at[of == j], share[j]) for j in range(k) if (of == j).any()]
    return np.stack(out)


class Graph:
    """Centroids and their neighbour graph."""

    def __init__(self, centroids: np.ndarray, degree: int = DEGREE):
        self.c = np.ascontiguousarray(centroids, np.float32)
        n = len(self.c)
        degree = min(degree, n - 1)
        near = np.zeros((n, degree), np.int64)
        for at in range(0, n, 1024):
            d = self._far(self.c[at : at + 1024])
            d[np.arange(len(d)), np.arange(at, at + len(d))] = np.inf
            near[at : at + 1024] = np.argpartition(d, max(degree - 1, 0), 1)[:, :degree] if degree else near[at : at + 1024]
        # Links in both directions, so that every centroid can be reached from its neighbours.
        back: list[list[int]] = [[] for _ in range(n)]
        for i in range(n):
            for j in near[i].tolist():
                back[j].append(i)
        rows = [sorted({*near[i].tolist(), *back[i]}) for i in range(n)]
        self.ends = np.cumsum([0, *map(len, rows)])
        self.links = np.array([j for row in rows for j in row], np.int64)
        self.entries = np.unique(np.linspace(0, n - 1, min(n, 16)).astype(np.int64))

    def _far(self, x: np.ndarray) -> np.ndarray:
        return (x**2).sum(1)[:, None] + (self.c**2).sum(1)[None] - 2 * x @ self.c.T

    def near(self, x: np.ndarray, ratio: float, least: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, centroid, distance) of the centroids within ``ratio`` of each row's nearest, nearest first.

        ``least`` of them are given in any case.
        """
        n, m = len(x), len(self.c)
        d = np.full((n, m), np.inf, np.float32)
        done = np.zeros((n, m), bool)
        rows, nodes = np.repeat(np.arange(n), len(self.entries)), np.tile(self.entries, n)
        first = True
        while len(rows):
            d[rows, nodes] = np.sqrt(((x[rows] - self.c[nodes]) ** 2).sum(1))
            best = d.min(1)
            rows, nodes = np.nonzero(~done & (d <= (best * (max(ratio, 1.1) + 1e-6))[:, None]))
            if first:  # from the entries only the nearest goes on
                rows, nodes, first = np.arange(n), d.argmin(1), False
            done[rows, nodes] = True
            size = self.ends[nodes + 1] - self.ends[nodes]
            step = np.repeat(self.ends[nodes] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
            pairs = np.unique(np.repeat(rows, size) * m + self.links[step])
            rows, nodes = pairs // m, pairs % m
            new = np.isinf(d[rows, nodes])
            rows, nodes = rows[new], nodes[new]
        least = min(least, m) - 1
        reach = np.maximum(d.min(1) * (ratio + 1e-6), np.partition(d, least, 1)[:, least])
        rows, nodes = np.nonzero((d <= reach[:, None]) & np.isfinite(d))
        order = np.lexsort((nodes, d[rows, nodes], rows))
        return rows[order], nodes[order], d[rows[order], nodes[order]]


def usable(vectors: DataFrame, id_col: str, vector: str) -> tuple[DataFrame, int]:
    """(id, v) of the vectors that take part, and their length."""
    kept = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector}`").alias("v")).where(F.col("id").isNotNull() & F.coalesce(fine_of("v"), F.lit(False)))
    size = kept.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    d = size[0]["d"] if size else 0
    return kept.where(F.size("v") == d), d


def fine_of(vector: str) -> Column:
    """Finite throughout and not zero."""
    v = F.col(vector)
    return F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(-1, d)


def assign(vectors: DataFrame, graph, d: int, ratio: float, least: int, copies: int) -> DataFrame:
    """(list, id, v): the lists of every vector, ``least`` at least as far as there are, ``copies`` at most."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                rows, nodes, _ = graph.value.near(_matrix(part.column(1), d).astype(np.float32), ratio, least)
                turn = np.arange(len(rows)) - np.searchsorted(rows, rows)
                take = turn < copies
                own = part.take(pa.array(rows[take]))
                yield pa.RecordBatch.from_arrays([pa.array(nodes[take], pa.int32()), own.column(0), own.column(1)], names=["list", "id", "v"])

    kind = vectors.schema["v"].dataType.simpleString()
    return vectors.select("id", "v").mapInArrow(run, f"list int, id long, v {kind}")


def fit(vectors: DataFrame, d: int, n: int, sample: int = SAMPLE, most: int = MOST_LISTS) -> Graph:
    """The centroid graph for ``n`` vectors, from a bounded sample."""
    rows = vectors.orderBy(F.xxhash64("id"), "id").limit(sample).toArrow()
    column = rows.column("v").combine_chunks()
    x = _matrix(column if isinstance(column, pa.Array) else pa.concat_arrays(column.chunks), d).astype(np.float32)
    return Graph(balanced(x, max(1, min(most, int(n**0.5 / 2), len(x)))))


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector: str = "embedding", prune: float = PRUNE, boundary: float = BOUNDARY, copies: int = COPIES, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of each query among all ``vectors``."""
    spark = vectors.sparkSession
    out_kind = "query_id long, rank int, vec_id long, score double"
    base, d = usable(vectors, id_col, vector)
    if not d:
        return spark.createDataFrame([], out_kind)
    asked = queries.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector}`").alias("v")).where(F.col("id").isNotNull() & F.coalesce(fine_of("v"), F.lit(False)) & (F.size("v") == d))
    graph = spark.sparkContext.broadcast(fit(base, d, base.count()))
    postings = settle(assign(base, graph, d, boundary, 1, copies), "postings")
    # One row for each list, bounded by MOST_LISTS.
    sizes = postings.groupBy("list").agg(F.count(F.lit(1)).alias("n")).select("list", F.ceil(F.col("n") / block).cast("int").alias("parts"))
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    dealt = lambda n, to: F.pmod(F.xxhash64("id"), F.col(n)).cast("int").alias(to)

    def nearest(own: pa.Table, asking: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        if own.num_rows and asking.num_rows:
            ids, x = np.asarray(own.column("id")), _matrix(own.column("v").combine_chunks(), d)
            order = np.argsort(ids, kind="stable")
            ids, x = ids[order], x[order]
            again = (ids[1:] == ids[:-1]) & (x[1:] == x[:-1]).all(1)
            ids, x = ids[np.r_[True, ~again]], x[np.r_[True, ~again]]
            firsts = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
            norms = (x**2).sum(1)
            qids, q = np.asarray(asking.column("id")), _matrix(asking.column("v").combine_chunks(), d)
            for at in range(0, len(q), 256):
                some = q[at : at + 256]
                rough = (some**2).sum(1)[:, None] + norms[None] - 2 * some @ x.T
                slack = 1e-9 * (1 + norms.max() + (some**2).sum(1).max())
                for i, far in enumerate(rough):
                    own_id = int(qids[at + i])
                    far[ids == own_id] = np.inf
                    best = np.minimum.reduceat(far, firsts) if len(firsts) < len(far) else far  # one for each id
                    reach = np.partition(best, k - 1)[k - 1] if len(best) > k else far.max(initial=0, where=np.isfinite(far))
                    near = np.flatnonzero(far <= reach + slack)
                    near = near[np.isfinite(far[near])]
                    exact = np.sqrt(((x[near] - some[i]) ** 2).sum(1))
                    order = np.lexsort((ids[near], exact))
                    for j in order[np.sort(np.unique(ids[near[order]], return_index=True)[1])][:k].tolist():
                        rows.append((own_id, int(ids[near[j]]), float(exact[j])))
        columns = [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 3, (pa.int64(), pa.int64(), pa.float64()))]
        return pa.Table.from_arrays(columns, names=["query_id", "vec_id", "score"])

    def look(wanted: DataFrame) -> DataFrame:
        """(query_id, vec_id, score): the best of each list that a query wants."""
        asks = wanted.groupBy("list").agg(F.count(F.lit(1)).alias("n")).select("list", F.ceil(F.col("n") / QUERY_BLOCK).cast("int").alias("turns"))
        cells = settle(sizes.join(asks, "list").coalesce(1), "cells")
        left = postings.join(F.broadcast(cells), "list").select("list", dealt("parts", "part"), spread("turns").alias("turn"), "id", "v")
        right = wanted.join(F.broadcast(cells), "list").select("list", spread("parts").alias("part"), dealt("turns", "turn"), "id", "v")
        key = ("list", "part", "turn")
        found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(nearest, "query_id long, vec_id long, score double")
        return settle(found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score")), "near")

    once, lists = look(settle(assign(asked, graph, d, prune, LEAST_LISTS, 1 << 30), "wanted")), len(graph.value.c)
    if lists > LEAST_LISTS:  # queries whose lists held too little take all lists
        enough = once.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= k)
        short, n = settle_counted(asked.join(enough, F.col("id") == F.col("query_id"), "left_anti"), "short")
        if n:
            more = look(settle(short.withColumn("list", F.explode(F.sequence(F.lit(0), F.lit(lists - 1)))), "wanted"))
            once = once.unionAll(more).groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return once.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return search(vectors, vectors.where("vec_id % 100 = 0"))
