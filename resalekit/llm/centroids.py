"""Centroid clustering with the threshold algorithm (operator 13).

Each dimension has a list of the centroids sorted by their value there. From a
vector's own value a list is walked outward, the nearer neighbour first; a
centroid that is met in any list gets its exact distance. The squared distances of the next
centroids in all lists, the frontiers, add up to a bound that no centroid yet to be
met is below. When the bound strictly exceeds the best distance, the
best centroid is known: one that was not met cannot even tie.

Vectors are cleaned and staged once. A round is one scan: tasks sum their
vectors by cluster, the sums are summed again by a few tasks, and the driver divides
k rows of sums. Integers are exact at any size."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage
from .vectors import SMALL, longs, matrix, scaled, usable

SIZE, CLUSTERS, ROUNDS, SEED = 64, 40, 5, "2"
#: Vectors that are walked together: a step holds some ten numbers per vector and dimension.
BLOCK = 4096
#: Tasks that sum the tasks' sums.
MERGES = 16


class Lists:
    """The centroids (rows of integers), and per dimension their values in order and their numbers."""

    def __init__(self, centroids: np.ndarray):
        self.rows = centroids
        self.order = np.argsort(centroids, axis=0, kind="stable").T  # dimension, place -> centroid
        self.values = np.take_along_axis(centroids.T, self.order, axis=1)

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(centroid, squared distance, exact distances taken) per vector; of equally near ones the smallest number."""
        if vectors.dtype == object or self.rows.dtype == object:
            vectors, rows = vectors.astype(object), self.rows.astype(object)
        else:
            rows = self.rows
        n, (dims, k) = len(vectors), self.order.shape
        best, best_at = np.full(n, -1, vectors.dtype), np.full(n, -1, np.int64)
        seen, met = np.zeros((n, k), bool), np.zeros(n, np.int64)
        # right: the place of the first value that is at least the vector's; left: the one before it
        right = np.stack([np.searchsorted(self.values[d], vectors[:, d]) for d in range(dims)], axis=1) if dims else np.zeros((n, 0), np.int64)
        left = right - 1
        open_ = np.arange(n)
        column = np.arange(dims)
        far = sum(int(np.abs(a).max()) if a.size else 0 for a in (vectors, self.values)) + 1  # more than any gap
        while len(open_):
            x = vectors[open_]
            down, up = left >= 0, right < k
            lower = x - self.values[column, np.maximum(left, 0)]
            upper = self.values[column, np.minimum(right, k - 1)] - x
            gap_l, gap_r = np.where(down, lower, far), np.where(up, upper, far)
            use_l = gap_l <= gap_r
            gap = np.where(use_l, gap_l, gap_r)
            # the frontiers: one list that has ended has been walked whole, so all centroids were met
            bound = (gap * gap).sum(axis=1) if dims else np.zeros(len(open_), np.int64)
            whole = seen[open_].all(axis=1)
            on = ~whole & ((best_at[open_] < 0) | (bound <= best[open_]))
            open_, left, right, use_l = open_[on], left[on], right[on], use_l[on]
            if not len(open_):
                break
            at = self.order[column, np.where(use_l, left, np.minimum(right, k - 1))]
            left, right = left - use_l, right + ~use_l
            new = np.zeros((len(open_), k), bool)
            np.put_along_axis(new, at, True, axis=1)
            if not dims:
                new[:] = True  # vectors without components are equally near to all
            new &= ~seen[open_]
            seen[open_] |= new
            i, c = np.nonzero(new)
            if not len(i):
                continue
            step = vectors[open_[i]] - rows[c]
            distance = (step * step).sum(axis=1)
            # pairs come by vector, then centroid: of the nearest of a vector the first is the smallest number
            first = np.flatnonzero(np.concatenate([[True], i[1:] != i[:-1]]))
            own = open_[i[first]]
            least = np.minimum.reduceat(distance, first)
            spread = np.repeat(least, np.diff([*first, len(i)]))
            number = np.minimum.reduceat(np.where(distance == spread, c, k), first)
            met[own] += np.diff([*first, len(i)])
            better = (best_at[own] < 0) | (least < best[own]) | ((least == best[own]) & (number < best_at[own]))
            best[own[better]], best_at[own[better]] = least[better], number[better]
        return best_at, best, met


def _blocks(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            part = batch.slice(at, BLOCK)
            yield part, scaled(matrix(part.column("x")))


def _sums(vectors: DataFrame, centroids: np.ndarray) -> dict[int, tuple[int, list[int]]]:
    """Count and componentwise sum of each non-empty cluster. Sums travel as text, so they have no limit."""

    def emit(total):
        rows = [(c, n, [str(v) for v in s]) for c, (n, s) in total.items()]
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int64()),
                                           pa.array([r[2] for r in rows], pa.list_(pa.string()))], ["c", "n", "s"])

    def add(total, c, n, s):
        had = total.get(c)
        total[c] = (had[0] + n, had[1] + s) if had else (n, s)

    def assign(batches):
        lists, total = Lists(centroids), {}
        for _, x in _blocks(batches):
            at, _, _ = lists.nearest(x)
            for c in np.unique(at).tolist():
                own = x[at == c]
                add(total, c, len(own), own.sum(axis=0).astype(object))
        yield emit(total)

    def merge(batches):
        total = {}
        for batch in batches:
            for c, n, s in zip(*(batch.column(i).to_pylist() for i in range(3))):
                add(total, c, n, np.array([int(v) for v in s], object))
        yield emit(total)

    schema = "c int, n bigint, s array<string>"
    parts = vectors.select("x").mapInArrow(assign, schema).repartition(MERGES).mapInArrow(merge, schema)
    total = {}
    for r in parts.collect():  # at most MERGES rows for each centroid
        add(total, r.c, r.n, np.array([int(v) for v in r.s], object))
    return {c: (n, s.tolist()) for c, (n, s) in total.items()}


def _small(rows: list[list[int]], size: int) -> np.ndarray:
    out = np.array(rows, object).reshape(len(rows), size)
    return out.astype(np.int64) if not out.size or max(abs(v) for v in out.ravel()) < SMALL else out


def fit(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: str = SEED, size: int = SIZE) -> np.ndarray:
    """The centroids after ``rounds`` rounds, from the ``clusters`` vectors (vec_id, x) with the smallest
    sha256 of ``<seed>:<vec_id>``; rows with one vec_id come by their components, null ids last."""
    first = vectors.select(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256).alias("h"), "x")
    first = first.orderBy(F.col("h").asc_nulls_last(), "x").limit(clusters).select("x").collect()  # k rows
    centroids = _small(scaled(np.array([r.x for r in first], float).reshape(len(first), size)).tolist(), size)
    for _ in range(rounds if len(first) else 0):
        rows = centroids.tolist()
        for c, (n, s) in _sums(vectors, centroids).items():
            rows[c] = [v // n for v in s]
        centroids = _small(rows, size)
    return centroids


def cluster(rows: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: str = SEED, size: int = SIZE) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid (its components) and n_met (the
    centroids whose exact distance was taken) per row of (vec_id, embedding) whose embedding has ``size``
    components, none null or not finite; others take no part.

    Repeated rows and ids are vectors of their own. Fewer vectors than ``clusters``: as many
    centroids. No vectors: no rows. A distance or sum beyond a long is null. Other columns are not
    read. Broadcast are the centroids alone, ``clusters`` rows of ``size`` integers."""
    spark = rows.sparkSession
    vectors = rows.filter(usable("embedding", size)).select(F.col("vec_id").cast("bigint").alias("vec_id"),
                                                            F.col("embedding").cast("array<double>").alias("x"))
    vectors = stage(vectors, "vectors")
    centroids = fit(vectors, clusters, rounds, seed, size)

    def assign(batches):
        lists = Lists(centroids)
        for part, x in _blocks(batches):
            at, distance, met = lists.nearest(x)
            yield pa.RecordBatch.from_arrays([part.column("vec_id"), pa.array(at, pa.int32()), longs(distance), pa.array(met, pa.int32())],
                                             ["vec_id", "cluster", "distance", "n_met"])

    found = stage(vectors.mapInArrow(assign, "vec_id bigint, cluster int, distance bigint, n_met int"), "assigned")
    exact = F.sum(F.col("distance").cast("decimal(38,0)"))
    # a distance that has no value leaves its sums without one
    total = F.when(F.count("distance") == F.count(F.lit(1)), exact).alias("t")
    per = found.groupBy("cluster").agg(total).collect()  # a row for each centroid
    long_ = lambda v: int(v) if v is not None and v < 1 << 63 else None
    every = None if any(r.t is None for r in per) else sum(r.t for r in per)
    kinds = "cluster int, centroid array<decimal(38,0)>, cluster_inertia bigint, inertia bigint"
    named = [(r.cluster, list(map(str, centroids[r.cluster].tolist())), long_(r.t), long_(every)) for r in per]
    table = spark.createDataFrame(named, kinds.replace("decimal(38,0)", "string"))
    return found.join(F.broadcast(table), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid", "n_met")
