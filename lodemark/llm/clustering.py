"""Centroid clustering with integer distances and partial-distance search.

Each round is one pass over the vectors: a task holds the centroids (at most
CENTROIDS of DIMENSIONS integers), assigns its vectors and gives the number and
the component sums of each cluster, at most CENTROIDS rows a task, which are
added up by cluster. What reaches the driver is one row a cluster. A lost
executor only costs its tasks of the current pass: no state but the centroids
is carried from one pass to the next.

The search adds squared differences dimension by dimension in falling order of
variance, STEP of them at a time. After the first step each vector finishes the
distance to the centroid that looks nearest; then every other centroid is left
for those vectors whose partial sum is strictly above the best so far, and only
survivors go on. A distance is a sum of squares, so a centroid left early could
not have won; equal distances go to the smaller number.

Defined results: a vector that is null, has not exactly DIMENSIONS components,
or has one that is null, NaN, infinite or of magnitude LARGEST or more (its
square would not fit a long) has no row; repeated rows count each; a null id is
clustered like others but starts no centroid; vectors with equal ids start in
order of their components; fewer kept ids than CENTROIDS give fewer centroids,
none give an empty result; extra columns are ignored. Sums and inertia are
exact as long as they fit a long.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

CENTROIDS, DIMENSIONS, ROUNDS = 40, 64, 5
#: Components become floor(SCALE * x).
SCALE = 256
#: In the scaled integers: (2 * 2^26)^2 * 64 is below 2^63.
LARGEST = 1 << 26
#: Dimensions that are added before centroids are given up.
STEP = 8
SEED = "2"


def scaled(vectors: pa.Array, dimensions: int = DIMENSIONS) -> tuple[np.ndarray, np.ndarray]:
    """Which rows are kept, and their integers (one row each)."""
    if pa.types.is_fixed_size_list(vectors.type):
        vectors = vectors.cast(pa.list_(vectors.type.value_type))
    right = pc.fill_null(pc.equal(pc.list_value_length(vectors), dimensions), False).to_numpy(zero_copy_only=False)
    flat = vectors.filter(pa.array(right)).flatten()
    x = pc.fill_null(flat.cast(pa.float64()), math.nan).to_numpy(zero_copy_only=False).reshape(-1, dimensions)
    good = (np.abs(SCALE * x) < LARGEST).all(axis=1)  # false for NaN and infinities
    right[np.flatnonzero(right)[~good]] = False
    return right, np.floor(SCALE * x[good]).astype("i8")


def nearest(points: np.ndarray, centroids: np.ndarray, order: np.ndarray, step: int = STEP) -> tuple[np.ndarray, np.ndarray, int]:
    """Number of each point's nearest centroid, the squared distance, and how many terms were added."""
    n, (k, d) = len(points), centroids.shape
    x, c = np.ascontiguousarray(points[:, order].T), centroids[:, order]  # by dimension: a step reads neighbours in memory
    first = np.zeros((k, n), dtype="i8")
    for j in range(min(step, d)):
        first += (x[j] - c[:, j : j + 1]) ** 2
    best_k = first.argmin(axis=0)
    best = first[best_k, np.arange(n)]
    for j in range(step, d):
        best += (x[j] - c[best_k, j]) ** 2
    terms, guess = first.size * min(step, d) + n * max(0, d - step), best_k.copy()
    for i in range(k):
        alive = np.flatnonzero((first[i] <= best) & (guess != i))
        part = first[i, alive]
        for at in range(step, d, step):
            if not len(alive):
                break
            for j in range(at, min(at + step, d)):
                part += (x[j, alive] - c[i, j]) ** 2
            terms += len(alive) * (min(at + step, d) - at)
            keep = part <= best[alive]
            alive, part = alive[keep], part[keep]
        wins = (part < best[alive]) | (i < best_k[alive])
        best[alive[wins]], best_k[alive[wins]] = part[wins], i
    return best_k, best, terms


def _summed(vectors: DataFrame, vector: str, centroids: np.ndarray, order: np.ndarray) -> dict[int, tuple[int, int, list[int]]]:
    """Of every non-empty cluster the number of its vectors, the sum of distances and the sums of components."""
    k, d = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, away, sums = np.zeros(k, "i8"), np.zeros(k, "i8"), np.zeros((k, d), "i8")
        for batch in batches:
            _, points = scaled(batch.column(0), d)
            cluster, distance, _ = nearest(points, centroids, order)
            rank = np.argsort(cluster, kind="stable")
            found, at = np.unique(cluster[rank], return_index=True)
            if len(found):
                counts[found] += np.diff([*at, len(rank)])
                away[found] += np.add.reduceat(distance[rank], at)
                sums[found] += np.add.reduceat(points[rank], at, axis=0)
        full = np.flatnonzero(counts)
        names = ["cluster", "n", "away", *[f"s{j}" for j in range(d)]]
        yield pa.RecordBatch.from_arrays([pa.array(full.astype("i4")), pa.array(counts[full]), pa.array(away[full]), *[pa.array(sums[full, j]) for j in range(d)]], names=names)

    columns = ["n", "away", *[f"s{j}" for j in range(d)]]
    rows = vectors.select(vector).mapInArrow(run, "cluster int, " + ", ".join(f"{c} long" for c in columns))
    got = rows.groupBy("cluster").agg(*[F.sum(c).alias(c) for c in columns]).collect()  # one row a cluster
    return {r["cluster"]: (r["n"], r["away"], [r[f"s{j}"] for j in range(d)]) for r in got}


def first_centroids(vectors: DataFrame, key: str, vector: str, centroids: int, dimensions: int, seed: str) -> np.ndarray:
    """The vectors whose ids have the smallest hashes, in that order."""
    x = F.col(vector)
    fits = (F.size(x) == dimensions) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double") * SCALE) < LARGEST))
    named = vectors.filter(fits & F.col(key).isNotNull()).select(
        F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256).alias("h"), F.transform(x, lambda v: F.floor(v.cast("double") * SCALE)).alias("x")
    )
    rows = named.orderBy("h", "x").limit(centroids).collect()
    return np.array([r["x"] for r in rows], dtype="i8").reshape(-1, dimensions)


def by_variance(vectors: DataFrame, vector: str, dimensions: int) -> np.ndarray:
    """Dimensions in falling order of variance over all vectors. Only the order of work depends on it, never a result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, q = 0, np.zeros(dimensions), np.zeros(dimensions)
        for batch in batches:
            points = scaled(batch.column(0), dimensions)[1].astype("f8")
            n, s, q = n + len(points), s + points.sum(axis=0), q + (points**2).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dimensions, dtype="i4")), pa.array(np.full(dimensions, float(n))), pa.array(s), pa.array(q)], names=["d", "n", "s", "q"])

    rows = vectors.select(vector).mapInArrow(run, "d int, n double, s double, q double").groupBy("d").agg(*[F.sum(c).alias(c) for c in "nsq"])
    spread = {r["d"]: r["q"] / r["n"] - (r["s"] / r["n"]) ** 2 if r["n"] else 0.0 for r in rows.collect()}
    return np.array(sorted(range(dimensions), key=lambda j: (-spread.get(j, 0.0), j)))


def cluster_vectors(
    vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", *, centroids: int = CENTROIDS, dimensions: int = DIMENSIONS, rounds: int = ROUNDS, seed: str = SEED
) -> DataFrame:
    """Per kept vector: key, cluster, distance, cluster_inertia, inertia and the final centroid's hash. The rounds run when this is called."""
    small_batches(vectors.sparkSession)
    at, order = first_centroids(vectors, key, vector, centroids, dimensions, seed), by_variance(vectors, vector, dimensions)
    for _ in range(rounds if len(at) else 0):
        for i, (n, _, sums) in _summed(vectors, vector, at, order).items():
            at[i] = [s // n for s in sums]
    away = {i: x for i, (_, x, _) in _summed(vectors, vector, at, order).items()} if len(at) else {}
    inertia = np.array([away.get(i, 0) for i in range(len(at))], dtype="i8")
    total = int(sum(away.values()))
    hashes = np.array([hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in at.tolist()], dtype=object)
    names = [key, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, points = scaled(batch.column(1), dimensions)
            if len(points) and len(at):
                cluster, distance, _ = nearest(points, at, order)
                columns = [pa.array(cluster.astype("i4")), pa.array(distance), pa.array(inertia[cluster]), pa.array(np.full(len(points), total)), pa.array(hashes[cluster], pa.string())]
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(kept)), *columns], names=names)

    kind = vectors.schema[key].dataType.simpleString()
    return vectors.select(key, vector).mapInArrow(run, f"`{key}` {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
