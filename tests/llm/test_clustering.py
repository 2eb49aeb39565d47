"""Centroid clustering against a plain loop over all centroids."""

import hashlib
import math
import random

import numpy as np
import pytest

from lodemark.llm import clustering as C


def brute(rows, k, d, rounds):
    """vec_id -> sorted (cluster, distance, cluster inertia, inertia, hash), by the definition."""
    kept = []
    for i, v in rows:
        if v is not None and len(v) == d and all(x is not None and math.isfinite(x) and abs(256 * x) < C.LARGEST for x in v):
            kept.append((i, [math.floor(256 * float(np.float32(x))) for x in v]))
    first = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:k]
    at = [v for _, v in first]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(at))
    for _ in range(rounds if at else 0):
        own = [near(v)[1] for _, v in kept]
        for j in range(len(at)):
            mine = [v for (_, v), o in zip(kept, own, strict=True) if o == j]
            if mine:
                at[j] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    got = [(i, *near(v)) for i, v in kept] if at else []
    total, each = sum(x[1] for x in got), {}
    for _, distance, j in got:
        each[j] = each.get(j, 0) + distance
    name = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in at]
    return sorted(((i, j, distance, each[j], total, name[j]) for i, distance, j in got), key=repr)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_all_rounds_with_odd_rows(spark):
    r = random.Random(5)
    centres = [[r.uniform(-1, 1) for _ in range(6)] for _ in range(5)]
    rows = [(i, [c + r.gauss(0, 0.1) for c in centres[i % 5]]) for i in range(120)]
    rows += [(7, rows[7][1])] * 3 + [(3, [0.5] * 6), (None, [0.25] * 6), (None, None)]  # repeated rows, equal ids, null ids
    rows += [(200, None), (201, []), (202, [1.0] * 5), (203, [1.0] * 7), (204, [1.0] * 5 + [None]), (205, [math.nan] * 6), (206, [math.inf] * 6), (207, [3e38] * 6), (208, [-0.001, 0.0, -0.0, 1e-9, 2.0, -2.0])]
    rows += [(300 + i, [0.5] * 6) for i in range(40)]  # one vector many times
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<float>, cluster string, n long").repartition(5)
    assert rows_of(C.cluster_vectors(df, centroids=9, dimensions=6)) == brute(rows, 9, 6, 5)


def test_fewer_vectors_than_centroids_and_none(spark):
    schema = "vec_id long, embedding array<float>"
    rows = [(i, [float(i)] * 3) for i in range(4)]
    assert rows_of(C.cluster_vectors(spark.createDataFrame(rows, schema), centroids=9, dimensions=3)) == brute(rows, 9, 3, 5)
    empty = C.cluster_vectors(spark.createDataFrame([], schema))
    assert empty.collect() == [] and empty.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


@pytest.mark.parametrize("seed", range(6))
def test_partial_search_is_exact_and_does_less(seed):
    r = np.random.default_rng(seed)
    c = r.integers(-300, 300, (40, 64)) * np.linspace(1, 0.1, 64)
    c = c.astype("i8")
    c[7] = c[3]  # a tie between centroids
    x = c[r.integers(0, 40, 500)] + r.integers(-20, 20, (500, 64))
    x[:20] = c[3]
    d = ((x[:, None, :] - c[None]) ** 2).sum(axis=2)
    k, best, terms = C.nearest(x, c, np.argsort(-x.var(axis=0)))
    assert (k == d.argmin(axis=1)).all() and (best == d.min(axis=1)).all()
    assert terms < 0.5 * d.size * 64


def test_ids_of_any_type(spark):
    df = spark.createDataFrame([(f"a{i}", [float(i), 1.0]) for i in range(5)], "name string, e array<double>")
    got = C.cluster_vectors(df, "name", "e", centroids=2, dimensions=2)
    assert got.columns[0] == "name" and got.count() == 5
