"""Exact quantiles against NumPy, on values of any spread."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodemark.operators import quantiles as Q

SHARES = [0.0, 0.05, 0.25, 1 / 3, 0.5, 0.9, 1.0]


def series(kind, n=3000):
    r = random.Random(kind)
    make = {
        "even": lambda: r.random(), "heavy": lambda: r.choice([-1, 1]) * 10 ** r.uniform(-200, 200), "few": lambda: float(r.randrange(3)), "one": lambda: 7.5,
        "close": lambda: 1.0 + r.randrange(5) * 2**-52, "hot": lambda: 0.0 if r.random() < 0.7 else r.gauss(0, 1), "ends": lambda: r.choice([-1.7e308, 1.7e308, 0.0, 5e-324]),
    }[kind]
    return [make() for _ in range(n)]


def test_equal_to_numpy(spark):
    kinds = ["even", "heavy", "few", "one", "close", "hot", "ends"]
    rows = [(k, v) for k in kinds for v in series(k)] + [(None, 1.0), (None, 2.0), ("even", None), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(6)
    got = {r.g: (r.n, r.quantiles) for r in Q.exact_quantiles(df, ["g"], "v", SHARES).collect()}
    assert got.keys() == {*kinds, None} and got[None] == (2, [1.0, 1.05, 1.25, pytest.approx(4 / 3), 1.5, 1.9, 2.0])
    spark_own = {r.g: r.q for r in df.groupBy("g").agg(F.percentile("v", F.array(*map(F.lit, SHARES))).alias("q")).collect()}
    for k in kinds:
        values = sorted(v for g, v in rows if g == k and v is not None)
        assert got[k][0] == len(values)
        for p, x in zip(SHARES, got[k][1], strict=True):
            low, high = values[math.floor(p * (len(values) - 1))], values[math.ceil(p * (len(values) - 1))]
            assert low <= x <= high
        assert got[k][1] == pytest.approx(spark_own[k], rel=1e-12)
        if k != "ends":
            assert got[k][1] == pytest.approx(np.quantile(values, SHARES).tolist(), rel=1e-9)


def test_without_groups_and_without_rows(spark):
    df = spark.range(1001).select(F.col("id").cast("double").alias("v"))
    assert Q.exact_quantiles(df, [], "v", [0.5, 0.1]).first().quantiles == [500.0, 100.0]
    assert Q.exact_quantiles(df.limit(0), [], "v", [0.5]).count() == 0


def test_beyond_the_broadcast(spark, monkeypatch):
    monkeypatch.setattr(Q, "SMALL", 0)
    rows = [(g, float(v * v % 97)) for g in "ab" for v in range(200)]
    got = {r.g: r.quantiles for r in Q.exact_quantiles(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", [0.5, 0.95]).collect()}
    assert got["a"] == pytest.approx(np.quantile([v for g, v in rows if g == "a"], [0.5, 0.95]).tolist())
