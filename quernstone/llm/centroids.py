"""Exact k-means on integer vectors by Shallot search (Borgelt, 2020).

A vector remembers its nearest and its second-nearest centroid, an upper bound on the distance to the
nearest and a lower bound on the distance to all others. Bounds move with the centroids; while the upper one
is below the lower one nothing is computed. Where they fail, the distance to the nearest is renewed, then that
to the remembered second one; the search starts from the closer of the two and visits its neighbours in
ascending order. A centroid that beats the second-best distance lies within the distance to the start plus
that second-best distance of the start, so the ball shrinks as better ones are found, and the scan ends at
the first neighbour outside. Bounds are floating-point numbers rounded outwards; what they leave over is
compared by squared distances in integers, ties by the smaller number.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.llm.common import written
from quernstone.scratch import discard

#: Components beyond this give squared distances that may not fit a long.
LARGEST = 1 << 27
#: Relative slack of every rounded bound, far above the error of a square root and a sum.
SLACK = 1e-12


def up(x):
    return x + np.abs(x) * SLACK


def down(x):
    return x - np.abs(x) * SLACK


class Centroids:
    """The centroids of one pass with what a search needs of them; ``moved`` is how far each came since the last pass."""

    def __init__(self, at: np.ndarray, before: np.ndarray | None = None):
        self.at, k = at, len(at)
        squared = np.stack([((at - c) ** 2).sum(1) for c in at]) if k else np.zeros((0, 0), np.int64)
        gap = np.sqrt(squared.astype(np.float64))
        np.fill_diagonal(gap, np.inf)
        self.near = np.argsort(gap, axis=1, kind="stable")[:, : k - 1]
        self.gap = down(np.take_along_axis(gap, self.near, 1))
        self.half = self.gap[:, 0] / 2 if k > 1 else np.full(k, np.inf)
        self.compared = 0
        if not k:
            return
        moved = np.zeros(k) if before is None else up(np.sqrt(((at - before) ** 2).sum(1).astype(np.float64)))
        self.moved, first = moved, int(np.argmax(moved))
        rest = np.delete(moved, first).max(initial=0.0)
        self.others_moved = np.where(np.arange(k) == first, rest, moved.max(initial=0.0))

    def squared(self, x: np.ndarray, j: np.ndarray) -> np.ndarray:
        self.compared += len(x)
        return ((x - self.at[j]) ** 2).sum(1)

    def first_pass(self, x: np.ndarray):
        """Nearest and second-nearest centroid of each row, and the bounds, by all distances."""
        n, k = len(x), len(self.at)
        d1, d2 = np.full(n, np.iinfo(np.int64).max), np.full(n, np.iinfo(np.int64).max)
        a, s = np.zeros(n, np.int32), np.zeros(n, np.int32)
        for j in range(k):
            d = self.squared(x, np.full(n, j))
            better, second = d < d1, (d >= d1) & (d < d2)
            s, d2 = np.where(better, a, np.where(second, j, s)), np.where(better, d1, np.where(second, d, d2))
            a, d1 = np.where(better, j, a), np.where(better, d, d1)
        lower = down(np.sqrt(d2.astype(np.float64))) if k > 1 else np.full(n, np.inf)
        return a.astype(np.int32), s.astype(np.int32), up(np.sqrt(d1.astype(np.float64))), lower

    def next_pass(self, x, a, s, upper, lower):
        """The same after the centroids moved, by bounds and search balls."""
        a, s = a.copy(), s.copy()
        upper, lower = up(upper + self.moved[a]), down(lower - self.others_moved[a])
        if len(self.at) < 2:
            return a, s, upper, np.full(len(x), np.inf)
        rows = np.flatnonzero(upper >= np.maximum(lower, self.half[a]))
        d1 = self.squared(x[rows], a[rows])
        upper[rows] = up(np.sqrt(d1.astype(np.float64)))
        open_ = upper[rows] >= np.maximum(lower[rows], self.half[a[rows]])
        rows, d1 = rows[open_], d1[open_]
        p, q, y = a[rows], s[rows], x[rows]
        d2 = self.squared(y, q)
        swap = (d2 < d1) | ((d2 == d1) & (q < p))
        p, q, d1, d2 = np.where(swap, q, p), np.where(swap, p, q), np.where(swap, d2, d1), np.where(swap, d1, d2)
        start, known, radius = p.copy(), q.copy(), up(np.sqrt(d1.astype(np.float64)))
        live = np.arange(len(rows))
        for t in range(len(self.at) - 1):
            live = live[self.gap[start[live], t] <= up(radius[live] + up(np.sqrt(d2[live].astype(np.float64))))]
            if not len(live):
                break
            j = self.near[start[live], t]
            new = j != known[live]
            i, j = live[new], j[new]
            d = self.squared(y[i], j)
            first = (d < d1[i]) | ((d == d1[i]) & (j < p[i]))
            second = ~first & ((d < d2[i]) | ((d == d2[i]) & (j < q[i])))
            d2[i], q[i] = np.where(first, d1[i], np.where(second, d, d2[i])), np.where(first, p[i], np.where(second, j, q[i]))
            d1[i], p[i] = np.where(first, d, d1[i]), np.where(first, j, p[i])
        a[rows], s[rows] = p, q
        upper[rows], lower[rows] = up(np.sqrt(d1.astype(np.float64))), down(np.sqrt(d2.astype(np.float64)))
        return a, s, upper, lower


def quantised(vector: Column, dims: int, scale: int) -> tuple[Column, Column]:
    """Whether a vector is kept, and its components as integers floor(scale * x), x as double."""
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != F.lit(float("inf"))))
    return vector.isNotNull() & (F.size(vector) == dims) & sound, F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long"))


@dataclass
class Clustering:
    """``rows``: id, cluster and squared distance of every kept vector; ``centroids``: their final components; ``inertia`` by cluster."""

    rows: DataFrame
    centroids: list[list[int]]
    inertia: list[int]


def _pass(vectors: DataFrame, kind: str, now: Centroids, dims: int, fresh: bool) -> DataFrame:
    """Assign every vector: a row each with its bounds, and in each task a row for each cluster with count, component sums and inertia."""
    shape = f"id {kind}, v array<long>, a int, s int, upper double, lower double, d long, n long, sums array<long>"
    state = ["id", "v"] if fresh else ["id", "v", "a", "s", "upper", "lower"]

    def assign(batches):
        k = len(now.at)
        counts, sums, inertia, ids = np.zeros(k, np.int64), np.zeros((k, dims), np.int64), np.zeros(k, np.int64), None
        for b in batches:
            ids = b.column("id").type
            n = b.num_rows
            x = b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(n, dims)
            if n and np.abs(x).max() > LARGEST:
                raise ValueError(f"a component beyond {LARGEST} in units of 1/scale: squared distances would not fit a long")
            if fresh:
                a, s, upper, lower = now.first_pass(x)
            else:
                a, s, upper, lower = now.next_pass(x, *[b.column(c).to_numpy(zero_copy_only=False) for c in ("a", "s", "upper", "lower")])
            d = now.squared(x, a)
            order = np.argsort(a, kind="stable")
            held, starts = np.unique(a[order], return_index=True)
            if n:
                counts[held] += np.diff(np.r_[starts, n])
                sums[held] += np.add.reduceat(x[order], starts, axis=0)
                inertia[held] += np.add.reduceat(d[order], starts)
            none = pa.nulls(n, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("v"), pa.array(a), pa.array(s), pa.array(upper), pa.array(lower), pa.array(d), none, pa.nulls(n, pa.list_(pa.int64()))], ["id", "v", "a", "s", "upper", "lower", "d", "n", "sums"])
        if ids is not None:
            f, none = np.flatnonzero(counts), pa.nulls(int((counts > 0).sum()), pa.float64())
            arrays = [pa.nulls(len(f), ids), pa.nulls(len(f), pa.list_(pa.int64())), pa.array(f.astype(np.int32)), pa.nulls(len(f), pa.int32()), none, none, pa.array(inertia[f]), pa.array(counts[f]), pa.array(list(sums[f]), pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, ["id", "v", "a", "s", "upper", "lower", "d", "n", "sums"])

    return written(vectors.select(*state).mapInArrow(assign, shape), "assigned")


def _totals(done: DataFrame, k: int, dims: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Count, component sums and inertia by cluster; k * dims numbers, whatever the table's size."""
    parts = done.where("n is not null")
    counts, sums, inertia = np.zeros(k, np.int64), np.zeros((k, dims), np.int64), np.zeros(k, np.int64)
    for r in parts.groupBy("a").agg(F.sum("n").alias("n"), F.sum("d").alias("d")).collect():
        counts[r["a"]], inertia[r["a"]] = r["n"], r["d"]
    for r in parts.select("a", F.posexplode("sums").alias("at", "x")).groupBy("a", "at").agg(F.sum("x").alias("x")).collect():
        sums[r["a"], r["at"]] = r["x"]
    return counts, sums, inertia


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64, vec_id: str = "vec_id", vector: str = "embedding") -> Clustering:
    """k-means in integers: ``rounds`` of assignment and update, then one more assignment.

    Vectors with exactly ``dims`` components, none null or not finite, are kept; others are not in the result.
    A component x becomes floor(scale * x). The first centroids are the ``k`` kept vectors whose ids have the
    smallest lowercase-hex SHA-256 of ``1:<id>``, a null id as nothing; rows with the same id follow the order of
    their components. With fewer than ``k`` vectors each is a centroid. An update takes the exact floor of the
    mean of each component; a cluster without vectors keeps its centroid. Repeated rows are vectors of their
    own, an empty table gives an empty result, other columns are not read. A component beyond 2^27 after scaling
    is an error, as its squared distances need not fit a long.

    The table is read twice, then carried from pass to pass with its bounds as a written table, of which the last
    two exist at most; nothing is shuffled but sums of k * dims numbers a task. The centroids (k * dims
    numbers, and k * k distances between them) are sent to every task: their size is set by ``k`` alone.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    good, components = quantised(F.col(vector), dims, scale)
    kind = vectors.schema[vec_id].dataType.simpleString()
    kept = vectors.where(good).select(F.col(vec_id).alias("id"), components.alias("v"))
    name = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    seeds = [list(r["v"]) for r in kept.orderBy(name, "v").limit(k).select("v").collect()]
    now = Centroids(np.array(seeds, np.int64).reshape(len(seeds), dims))
    if len(seeds) and np.abs(now.at).max() > LARGEST:
        raise ValueError(f"a component beyond {LARGEST} in units of 1/scale: squared distances would not fit a long")
    state = _pass(kept, kind, now, dims, True)
    for _ in range(rounds):
        counts, sums, _inertia = _totals(state, len(seeds), dims)
        at = np.where((counts > 0)[:, None], sums // np.maximum(counts, 1)[:, None], now.at)
        now, last = Centroids(at, now.at), state
        state = _pass(last.where("n is null"), kind, now, dims, False)
        discard(last)
    inertia = _totals(state, len(seeds), dims)[2]
    rows = state.where("n is null").select(F.col("id").alias(vec_id), F.col("a").alias("cluster"), F.col("d").alias("distance"))
    return Clustering(rows, now.at.tolist(), inertia.tolist())


def report(found: Clustering) -> DataFrame:
    """Every vector's cluster and distance with its cluster's inertia, that of all, and the digest of its centroid."""
    spark = found.rows.sparkSession
    each = [(j, found.inertia[j], hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for j, c in enumerate(found.centroids)]
    small = spark.createDataFrame(each, "cluster int, cluster_inertia long, centroid_sha256 string")
    return found.rows.join(F.broadcast(small), "cluster").withColumn("inertia", F.lit(sum(found.inertia)).cast("long"))
