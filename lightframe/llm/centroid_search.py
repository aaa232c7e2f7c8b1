"""Centroid clustering by equal-average equal-variance search, exact in integers.

Centroids are sorted by the sum of their components. From a vector's own sum the search goes outward; with d dimensions
the squared distance is at least (difference of sums)^2 / d, and at least that plus (difference of deviations)^2, where
a deviation is the norm of a vector less its mean. The first inequality ends the search on both sides, the second
skips a centroid; what is left is finished by exact integer distances. Assignment runs in Arrow kernels that see all
centroids (K x d numbers), and each batch hands on one row of sums for each cluster it met, so that a round shuffles a few
rows whatever the number of vectors or the size of a cluster.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lightframe.llm.shared import stash

#: Components count as at most this far from 0, so that every squared distance of up to 128 dimensions fits a long.
BOUND = 1 << 27
_MANY = np.iinfo(np.int64).max


def integers(column: pa.ListArray, dims: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows have `dims` finite components, and floor(scale * x) of those rows."""
    at = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    kept = np.diff(at) == dims
    if column.null_count:
        kept &= ~np.asarray(column.is_null())
    values = column.values.to_numpy(zero_copy_only=False).astype(np.float64)  # nulls are NaN
    x = values[at[:-1][kept][:, None] + np.arange(dims)]
    finite = np.isfinite(x).all(axis=1)
    kept[np.flatnonzero(kept)[~finite]] = False
    return kept, np.clip(np.floor(scale * x[finite]), -BOUND, BOUND).astype(np.int64)


@dataclass(frozen=True)
class Centroids:
    """Integer centroids in the order of their sums, with their numbers."""

    vectors: np.ndarray
    numbers: np.ndarray

    @classmethod
    def of(cls, rows: list) -> Centroids:
        c = np.array(rows, np.int64)
        order = np.argsort(c.sum(axis=1), kind="stable")
        return cls(c[order], order)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """For each row its nearest centroid's number (ties: the smallest), the squared distance, and how many distances
        were computed in all."""
        c, d = self.vectors, x.shape[1]
        sums, deviations, norms = _moments(c)
        xs, xv, xn = _moments(x)
        best, number, done = np.full(len(x), _MANY), np.full(len(x), len(c)), 0
        active, high = np.arange(len(x)), np.searchsorted(sums, xs)
        low = high - 1
        largest = norms.max()
        while len(active):
            s = xs[active]
            below = np.where(low >= 0, np.abs(s - sums[np.maximum(low, 0)]), np.inf)
            above = np.where(high < len(c), np.abs(s - sums[np.minimum(high, len(c) - 1)]), np.inf)
            down = below <= above
            gap = np.minimum(below, above) ** 2 / d
            # bounds are floats: they reject only by more than their own error
            go = np.isfinite(gap) & (gap - 1e-12 * (xn[active] + largest) <= best[active])
            active, low, high, down, gap = active[go], low[go], high[go], down[go], gap[go]
            at = np.where(down, low, high)
            bound = gap + (xv[active] - deviations[at]) ** 2
            near = bound - 1e-12 * (xn[active] + norms[at]) <= best[active]
            rows, cand = active[near], at[near]
            dist = ((x[rows] - c[cand]) ** 2).sum(axis=1)
            done += len(rows)
            better = (dist < best[rows]) | ((dist == best[rows]) & (self.numbers[cand] < number[rows]))
            best[rows[better]], number[rows[better]] = dist[better], self.numbers[cand[better]]
            low, high = low - down, high + ~down
        return number, best, done


def _moments(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums of components, norms of what differs from the mean, squared norms."""
    sums = x.sum(axis=1)
    apart = ((x - sums[:, None] / x.shape[1]) ** 2).sum(axis=1)
    return sums.astype(np.float64), np.sqrt(apart), apart + sums.astype(np.float64) ** 2 / x.shape[1]


def _sums(centroids: Centroids, dims: int, scale: int):
    def run(batches):
        for b in batches:
            _, x = integers(b.column(1), dims, scale)
            number, _, _ = centroids.nearest(x)
            order = np.argsort(number, kind="stable")
            met, start, n = np.unique(number[order], return_index=True, return_counts=True)
            sums = np.add.reduceat(x[order], start, axis=0) if len(met) else np.empty((0, dims), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(met, pa.int32()), pa.array(n, pa.int64()), pa.array(list(sums), pa.list_(pa.int64()))], ["cluster", "n", "sums"])

    return run


def _assign(centroids: Centroids | None, dims: int, scale: int):
    def run(batches):
        for b in batches:
            kept, x = integers(b.column(1), dims, scale)
            number, dist, _ = centroids.nearest(x)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(kept)), pa.array(number, pa.int32()), pa.array(dist, pa.int64())], ["vec_id", "cluster", "distance"])

    return run


def seeds(vectors: DataFrame, k: int, seed: int, dims: int, scale: int) -> list[list[int]]:
    """The `k` kept vectors whose digest of seed and id is smallest; ties by components, null ids last."""
    fit = (F.size("v") == dims) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    first = vectors.where(F.coalesce(fit, F.lit(False))).select(digest.alias("h"), "v").orderBy(F.col("h").asc_nulls_last(), "v").limit(k)
    limit = lambda x: int(np.clip(np.floor(scale * x), -BOUND, BOUND))
    return [[limit(x) for x in r["v"]] for r in first.collect()]  # k rows


def clustered(df: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64, seed: int = 1) -> tuple[DataFrame, list[list[int]]]:
    """(vec_id, cluster, distance) of every kept vector, and the final centroids.

    Kept: vectors of exactly `dims` components, none null or non-finite, each turned into floor(scale * x), at most BOUND
    from 0. Each round assigns every vector to its nearest centroid (ties: the smaller number) and replaces those that have
    vectors by their componentwise floor of the mean. Repeated rows and ids count each time; fewer vectors than `k` give
    as many centroids, none an empty result. Other columns are not read."""
    kind = df.schema[id_col].dataType.simpleString()
    vectors = df.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    made = seeds(vectors, k, seed, dims, scale)
    if not made:
        return vectors.limit(0).select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), []
    for _ in range(rounds):
        part = vectors.mapInArrow(_sums(Centroids.of(made), dims, scale), "cluster int, n long, sums array<long>")
        whole = part.groupBy("cluster").agg(F.sum("n").alias("n"), *(F.sum(F.col("sums")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(dims)))
        for r in whole.collect():  # k rows
            made[r["cluster"]] = [int(r[f"s{i}"]) // r["n"] for i in range(dims)]
    return vectors.mapInArrow(_assign(Centroids.of(made), dims, scale), f"vec_id {kind}, cluster int, distance long"), made


def report(assigned: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """Adds the inertia of the row's cluster and of all rows (null if it exceeds a long), and the digest of its centroid."""
    rows = stash(assigned, "assigned")
    spark = rows.sparkSession
    inertia = {r["cluster"]: r["i"] for r in rows.groupBy("cluster").agg(F.try_sum("distance").alias("i")).collect()}  # k rows
    total = None if None in inertia.values() else sum(inertia.values())
    total = total if total is None or total <= _MANY else None
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    facts = spark.createDataFrame([(i, inertia.get(i), total, s) for i, s in enumerate(sha)], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
