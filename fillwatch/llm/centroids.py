"""Centroid clustering of whole-number vectors with n-simplex bounds.

Distances of a vector to several pivots, computed once and stored, are turned into the apex of a simplex over the pivots:
coordinates whose first ones place the vector's shadow in the pivots' space and whose last one is its height above
it. The Euclidean distance of two apexes is at most the distance of their vectors, and with the last sign of one turned
it is at least that. Each round drops the centroids whose lower bound lies above the least upper bound of a vector, and compares
what is left by exact whole-number distances. Rounding is allowed for with ``SLACK``, so no nearest centroid is dropped.

Rounds are one pass each over a stored table; a task returns one row of sums for each cluster it met. Only the centroids
(``k`` rows) and the pivots (from a sample of at most ``PIVOT_SAMPLE`` rows) pass through the driver.

Vectors of another length, null vectors and vectors with a null or non-finite component are not kept. Components
beyond 2^27 whole units are set to that, so that distances fit a long. Rows that repeat an id or a vector are rows like any other;
null ids come last among the starts. With fewer kept vectors than ``k`` all of them start. No kept vector gives no rows. Other columns
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fillwatch.llm.common import map_rows, stored, unit_hash
from fillwatch.llm.vectors import matrix, usable, whole

PIVOT_SAMPLE, MIN_HEIGHT, SLACK, BITS = 512, 1 / 64, 1e-5, 27
SUMS = "cluster INT, n BIGINT, compared BIGINT, total ARRAY<DECIMAL(38,0)>"


@dataclass(frozen=True)
class Simplex:
    """Pivots and the base simplex: row i holds the coordinates of pivot i in the space of the pivots before it."""

    pivots: np.ndarray
    base: np.ndarray

    @classmethod
    def over(cls, sample: np.ndarray, most: int) -> "Simplex":
        """Pivots chosen one after the other, each the highest above the simplex so far; flat ones are left out."""
        simplex = cls(sample[:1], np.zeros((1, 1)))
        while len(simplex.pivots) < min(most, len(sample)):
            apex = simplex.apexes(sample)
            best, reach = int(np.argmax(apex[:, -1])), float(np.sqrt((apex ** 2).sum(1)).max())
            if apex[best, -1] <= MIN_HEIGHT * reach:
                break
            n = len(simplex.pivots)
            base = np.zeros((n + 1, n + 1))
            base[:n, :n], base[n, :n] = simplex.base, apex[best]
            simplex = cls(np.vstack([simplex.pivots, sample[best:best + 1]]), base)
        return simplex

    def distances(self, rows: np.ndarray) -> np.ndarray:
        """Squared distances to the pivots, exact."""
        return np.stack([((rows - p) ** 2).sum(1) for p in self.pivots], axis=1)

    def apexes(self, rows: np.ndarray, squared: np.ndarray | None = None) -> np.ndarray:
        """Apex coordinates, one for each pivot, from the distances to the pivots; the last is the height."""
        d2 = (self.distances(rows) if squared is None else squared).astype(float)
        n = len(self.pivots)
        out = np.zeros((len(d2), n))
        for j in range(1, n):
            # the planes of points as far from pivot j and from pivot 0 as this one meet the axes before j - 1 known already
            b = self.base[j]
            out[:, j - 1] = (d2[:, 0] - d2[:, j] + (b ** 2).sum() - 2 * (out[:, :j - 1] @ b[:j - 1])) / (2 * b[j - 1])
        out[:, n - 1] = np.sqrt(np.maximum(d2[:, 0] - (out[:, :n - 1] ** 2).sum(1), 0.0))
        return out


def bounds(apex: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared lower and upper bounds of the distances of all rows to all others, slack included."""
    flat = ((apex[:, None, :-1] - other[None, :, :-1]) ** 2).sum(2)
    room = SLACK * (1.0 + (apex ** 2).sum(1)[:, None] + (other ** 2).sum(1)[None, :])
    return flat + (apex[:, None, -1] - other[None, :, -1]) ** 2 - room, flat + (apex[:, None, -1] + other[None, :, -1]) ** 2 + room


def nearest(rows: np.ndarray, apex: np.ndarray, centroids: np.ndarray, spots: np.ndarray) -> tuple[np.ndarray, int]:
    """Number of the nearest centroid (the smaller one of ties), and how many exact distances it took."""
    low, high = bounds(apex, spots)
    open_ = low <= high.min(1)[:, None]
    best = np.full(len(rows), np.iinfo(np.int64).max)
    out = np.argmax(open_, axis=1)
    several = open_.sum(1) > 1
    for c in range(len(centroids)):
        at = np.flatnonzero(several & open_[:, c])
        d = ((rows[at] - centroids[c]) ** 2).sum(1)
        less = d < best[at]
        best[at[less]], out[at[less]] = d[less], c
    return out, int(open_[several].sum())


@dataclass
class Clustering:
    """``assigned``: id, cluster, distance (squared) of every kept vector; the final centroids; exact distances per round, of how many."""

    assigned: DataFrame
    centroids: list[list[int]]
    compared: list[int]
    n: int


def cluster(vectors: DataFrame, *, vec_id: str = "vec_id", vec: str = "embedding", dims: int = 64, scale: int = 1024, k: int = 8,
            rounds: int = 10, pivots: int = 12, salt: str = "3:") -> Clustering:
    """``rounds`` rounds of assignment and replacement by floored means, from the ``k`` vectors with the least sha256 of salt and id."""
    v = F.col(vec).cast("array<double>")
    kept = stored(vectors.where((F.size(v) == dims) & usable(v)).select(F.col(vec_id).cast("long").alias("vec_id"), whole(v, scale, BITS).alias("v")),
                  "vectors")
    n = kept.count()
    start = kept.withColumn("h", F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")).cast("binary"), 256)) \
                .orderBy(F.col("h").asc_nulls_last(), "v").limit(k).collect()
    centroids = np.array([r["v"] for r in start], dtype=np.int64).reshape(-1, dims)
    if not n:
        return Clustering(kept.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), [], [], 0)
    sample = kept.orderBy(unit_hash(F.col("vec_id"), F.col("v")), "v").limit(PIVOT_SAMPLE).select("v").collect()
    simplex = Simplex.over(np.array([r["v"] for r in sample], dtype=np.int64).reshape(-1, dims), pivots)

    def cache(batch: pa.RecordBatch) -> pa.RecordBatch:
        apex = simplex.apexes(matrix(batch.column(1), dims))
        at = np.arange(len(apex) + 1, dtype=np.int32) * apex.shape[1]
        return pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(pa.array(at), pa.array(apex.ravel()))], ["vec_id", "v", "apex"])

    held = stored(map_rows(kept, cache, "vec_id BIGINT, v ARRAY<INT>, apex ARRAY<DOUBLE>"), "apexes")

    def judged(batch: pa.RecordBatch, now: np.ndarray, spots: np.ndarray):
        rows = matrix(batch.column("v"), dims)
        apex = batch.column("apex").flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1)
        return (rows, *nearest(rows, apex, now, spots))

    compared: list[int] = []
    for _ in range(rounds):
        now, spots = centroids, simplex.apexes(centroids)

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, count, took = np.zeros((len(now), dims), dtype=object), np.zeros(len(now), dtype=np.int64), 0
            for batch in batches:
                rows, which, exact = judged(batch, now, spots)
                took += exact
                for c in np.unique(which):
                    mine = rows[which == c]
                    total[c] += mine.sum(0).astype(object)
                    count[c] += len(mine)
            met = np.flatnonzero(count)
            if len(met):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(met, pa.int32()), pa.array(count[met]), pa.array([took] + [0] * (len(met) - 1), pa.int64()),
                     pa.array([[Decimal(int(x)) for x in total[c]] for c in met], pa.list_(pa.decimal128(38, 0)))],
                    ["cluster", "n", "compared", "total"])

        made = held.mapInArrow(sums, SUMS)
        at = [F.sum(F.col("total")[j]).alias(f"t{j}") for j in range(dims)]
        found = made.groupBy("cluster").agg(F.sum("n").alias("n"), F.sum("compared").alias("compared"), *at).collect()
        compared.append(sum(r["compared"] for r in found))
        centroids = centroids.copy()
        for r in found:
            centroids[r["cluster"]] = [int(r[f"t{j}"]) // r["n"] for j in range(dims)]

    final, spots = centroids, simplex.apexes(centroids)

    def place(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows, which, _ = judged(batch, final, spots)
        return pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(which.astype(np.int32)), pa.array(((rows - final[which]) ** 2).sum(1))],
                                          ["vec_id", "cluster", "distance"])

    assigned = stored(map_rows(held, place, "vec_id BIGINT, cluster INT, distance BIGINT"), "assigned")
    return Clustering(assigned, [[int(x) for x in c] for c in final], compared, n)


def described(found: Clustering) -> DataFrame:
    """Every vector with its distance, its cluster's and all clusters' sum of distances, and the hash of its centroid."""
    rows = found.assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()
    inertia = {r["cluster"]: int(r["s"]) for r in rows}
    if not inertia:
        return found.assigned.select("vec_id", "cluster", "distance", *[F.lit(0).cast("long").alias(c) for c in ("cluster_inertia", "inertia")],
                                     F.lit("").alias("centroid_sha256"))
    own = F.create_map(*[F.lit(x) for c, s in inertia.items() for x in (c, s)])
    text = F.create_map(*[F.lit(x) for c in inertia for x in (c, ",".join(map(str, found.centroids[c])))])
    return found.assigned.select("vec_id", "cluster", "distance", own[F.col("cluster")].cast("long").alias("cluster_inertia"),
                                 F.lit(sum(inertia.values())).cast("long").alias("inertia"),
                                 F.sha2(text[F.col("cluster")].cast("binary"), 256).alias("centroid_sha256"))
