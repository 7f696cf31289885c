"""Centroid clustering of whole-number vectors with exponion search.

Each vector carries its centroid a, an upper bound u of its distance to a, and a lower bound l of its distance to all other
centroids. Centroids move by a round; u grows by the move of a, l shrinks by the greatest move of another. While u stays
below l or below half the distance s from a to the nearest other centroid, nothing is looked at. Else u is made exact, and
if it still isn't below, only the centroids inside the ball of radius 2 u + s around a are scanned, taken from a's list of
all centroids by distance; the nearest two of them are the nearest two of all. The ball's radius is inclusive and skipping
needs a strict inequality, so that a centroid of equal distance and smaller number is never missed. Distances are compared
as whole numbers; bounds are doubles with a margin for rounding.

On Spark: one table of the vectors and their bounds is read and written by each round (a task needs its batch only), and
the k centroids go to the tasks with the function, 8 * k * components bytes. A round's sums are partial by task.

Edge cases: vectors that are null, of another number of components, or that hold null or non-finite components are left
out, and so are those with a scaled component of 2^27 or more in size, whose squared distances don't fit in a long; repeated
rows and ids are vectors like others, a row each; a null id hashes as an empty one; equal hashes are ordered by the vector;
with fewer than k vectors there are as many centroids as vectors; an empty table gives an empty result; sums over a cluster
that exceed a long are told as its greatest value; only vec_id and embedding are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from skein.session import remove, saved, scratch

from .common import prepare

#: Scaled components are below this in size: 64 squared differences fit in a long.
LIMIT = 1 << 27
#: Relative margin of the bounds for rounding.
MARGIN = 1e-9
#: Numbers that are subtracted at once.
AT_ONCE = 1 << 20


def whole_vectors(vectors: DataFrame, components: int, scale: int) -> DataFrame:
    """vec_id, embedding -> vec_id, v: floor(scale * x) of the components of vectors that can be used."""
    x = F.col("embedding")
    usable = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double") * scale) < LIMIT)
    return vectors.where(x.isNotNull() & (F.size(x) == components) & F.forall(x, usable)).select(
        "vec_id", F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("long")).alias("v")
    )


def first_centroids(kept: DataFrame, k: int, seed: str) -> np.ndarray:
    """The k vectors with the smallest hash of seed and id: k rows come to the driver."""
    name = F.sha2(F.concat(F.lit(seed), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = kept.select(name.alias("name"), "v").orderBy("name", "v").limit(k).collect()
    return np.array([r.v for r in rows], np.int64)


def squared(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of every row of v to every row of c."""
    out = np.empty((len(v), len(c)), np.int64)
    step = max(1, AT_ONCE // max(1, c.size))
    for i in range(0, len(v), step):
        gap = v[i : i + step, None, :] - c[None]
        out[i : i + step] = np.einsum("ijk,ijk->ij", gap, gap)
    return out


def nearest_two(d: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each row's squared distances to the centroids numbered so: the nearest one's number (the smallest of ties), its
    distance, and the distance of the next (infinite if there is none)."""
    best = d.min(1)
    mine = np.where(d == best[:, None], number, np.iinfo(np.int64).max).min(1)
    rest = np.where(number == mine[:, None], np.inf, np.sqrt(d.astype(np.float64)))
    return mine, np.sqrt(best.astype(np.float64)), rest.min(1)


class Exponion:
    """The centroids of a round, their lists by distance, and how far they came since the round before."""

    def __init__(self, now: np.ndarray, before: np.ndarray | None = None):
        self.c, k = now, len(now)
        between = np.sqrt(squared(now, now).astype(np.float64))
        self.order = np.argsort(between, axis=1, kind="stable")
        self.sorted = np.take_along_axis(between, self.order, 1)
        np.fill_diagonal(between, np.inf)
        self.near = between.min(1)
        move = np.zeros(k) if before is None else np.sqrt(((now - before) ** 2).sum(1).astype(np.float64))
        self.move = move
        self.other = np.array([np.delete(move, i).max(initial=0.0) for i in range(k)])

    def first(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """a, u, l and distances computed, without bounds to begin with."""
        a, u, low = nearest_two(squared(v, self.c), np.arange(len(self.c)))
        return a, u, low, np.full(len(v), len(self.c), np.int64)

    def again(self, v: np.ndarray, a: np.ndarray, u: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """a, u, l and distances computed, after the centroids moved."""
        u, low = (u + self.move[a]) * (1 + MARGIN), (low - self.other[a]) * (1 - MARGIN)
        a, scanned = a.copy(), np.zeros(len(v), np.int64)
        bound = np.maximum(low, self.near[a] / 2 * (1 - MARGIN))
        open_ = np.flatnonzero(~(u < bound))
        gap = v[open_] - self.c[a[open_]]
        u[open_] = np.sqrt((gap * gap).sum(1).astype(np.float64))
        scanned[open_] += 1
        open_ = open_[~(u[open_] * (1 + MARGIN) < bound[open_])]
        radius = (2 * u[open_] + self.near[a[open_]]) * (1 + MARGIN)
        for own in np.unique(a[open_]):
            here = a[open_] == own
            rows, count = open_[here], self.sorted[own].searchsorted(radius[here], "right")
            ring = np.ceil(np.log2(np.maximum(count, 1))).astype(int)  # rows whose lists are of about the same length go together
            for r in np.unique(ring):
                some, many = rows[ring == r], count[ring == r]
                number = self.order[own][: many.max()]
                d = squared(v[some], self.c[number])
                a[some], u[some], low[some] = nearest_two(d, number)
                scanned[some] += len(number)
        return a, u, low, scanned


def _assigned(table: DataFrame, search: Exponion, carried: bool) -> DataFrame:
    """vec_id, v (with bounds if carried) -> vec_id, v, a, u, l, scanned (distances computed so far)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = search.c.shape[1]
        for b in batches:
            if not b.num_rows:
                continue
            v = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, d)
            if carried:
                a, u, low, done = (b.column(i).to_numpy(zero_copy_only=False) for i in range(2, 6))
                a, u, low, scanned = search.again(v, a.astype(np.int64), u, low)
                scanned = scanned + done
            else:
                a, u, low, scanned = search.first(v)
            cols = [pa.array(a, pa.int32()), pa.array(u, pa.float64()), pa.array(low, pa.float64()), pa.array(scanned, pa.int64())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *cols], names=["vec_id", "v", "a", "u", "l", "scanned"])

    kind = table.schema["vec_id"].dataType.simpleString()
    return table.mapInArrow(run, f"vec_id {kind}, v array<long>, a int, u double, l double, scanned long")


def _moved(state: DataFrame, now: np.ndarray) -> np.ndarray:
    """Floors of the means of each centroid's vectors; k rows of sums come to the driver. Without vectors a centroid stays."""
    d = now.shape[1]
    sums = state.groupBy("a").agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.get("v", F.lit(i)).cast("decimal(20,0)")).alias(f"s{i}") for i in range(d)])
    out = now.copy()
    for r in sums.collect():
        out[r.a] = [int(r[f"s{i}"]) // r.n for i in range(d)]
    return out


def _long(total: Column) -> Column:
    return F.least(total, F.lit((1 << 63) - 1).cast("decimal(38,0)")).cast("long")


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, components: int = 64, scale: int = 64, seed: str = "1:") -> DataFrame:
    """vec_id, embedding -> vec_id, cluster, distance (squared, in scaled whole numbers), cluster_inertia, inertia (distance
    summed over the cluster and over all), centroid_sha256 (of the centroid's components joined by commas), scanned
    (distances computed for this vector in all rounds): a row for each vector that can be used."""
    spark: SparkSession = vectors.sparkSession
    prepare(spark)
    folder = scratch(spark, "centroids")
    state = saved(whole_vectors(vectors, components, scale), f"{folder}/0")
    now = first_centroids(state, k, seed)
    if not len(now):
        now = np.zeros((1, components), np.int64)
    before = None
    for i in range(rounds + 1):
        state = saved(_assigned(state, Exponion(now, before), carried=i > 0), f"{folder}/{i + 1}")
        remove(spark, f"{folder}/{i}")
        if i < rounds:
            before, now = now, _moved(state, now)
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in now.tolist()]
    told = spark.createDataFrame([(i, c, n) for i, (c, n) in enumerate(zip(now.tolist(), names))], "a int, c array<long>, centroid_sha256 string")
    gaps = F.aggregate(F.zip_with("v", "c", lambda x, y: (x - y) * (x - y)), F.lit(0).cast("long"), lambda t, x: t + x)
    near = state.join(F.broadcast(told), "a").select("vec_id", F.col("a").alias("cluster"), gaps.alias("distance"), "centroid_sha256", "scanned")
    by = near.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("t")).collect()  # k rows at most
    totals = [(r.cluster, r.t, sum(x.t for x in by)) for r in by]
    totals = spark.createDataFrame(totals, "cluster int, t decimal(38,0), w decimal(38,0)")
    return near.join(F.broadcast(totals), "cluster").select(
        "vec_id", "cluster", "distance", _long(F.col("t")).alias("cluster_inertia"), _long(F.col("w")).alias("inertia"), "centroid_sha256", "scanned"
    )
