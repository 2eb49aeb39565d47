"""Scalar functions against Python's own, and kernels against hand-computed series."""

import math
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodemark.functions import scalars as X
from lodemark.functions import text as TX
from lodemark.operators import recurrence as K
from lodemark.operators import strategies as G


def values(spark, column, rows, schema):
    df = spark.createDataFrame(rows, schema)
    return [r[0] for r in df.select(column).collect()]


def test_normal_distribution(spark):
    p = [0.001, 0.02, 0.3, 0.5, 0.77, 0.98, 0.9999]
    got = values(spark, X.normal_ppf(F.col("p")), [(x,) for x in p], "p double")
    assert got == pytest.approx([NormalDist().inv_cdf(x) for x in p], abs=1e-7)
    x = [-4.0, -1.0, 0.0, 0.3, 2.5]
    assert values(spark, X.normal_cdf(F.col("x")), [(v,) for v in x], "x double") == pytest.approx([NormalDist().cdf(v) for v in x], abs=2e-7)
    assert values(spark, X.two_sided_p(F.col("x")), [(v,) for v in x], "x double") == pytest.approx([math.erfc(abs(v) / math.sqrt(2)) for v in x], abs=4e-7)
    assert values(spark, X.normal_ppf(F.col("p")), [(0.0,), (1.0,)], "p double") == [None, None]


def test_sharpe_adjustments(spark):
    z = NormalDist().inv_cdf
    got = values(spark, X.expected_max_sharpe(F.col("n"), F.lit(0.1)), [(10,), (500,)], "n int")
    assert got == pytest.approx([0.1 * ((1 - X.EULER_GAMMA) * z(1 - 1 / n) + X.EULER_GAMMA * z(1 - 1 / (n * math.e))) for n in (10, 500)], abs=1e-7)
    got = values(spark, X.deflated_sharpe(F.col("s"), F.lit(0.05), F.lit(101), F.lit(-0.2), F.lit(4.0)), [(0.1,)], "s double")[0]
    assert got == pytest.approx(NormalDist().cdf(0.05 * 10 / math.sqrt(1 + 0.2 * 0.1 + 0.75 * 0.01)), abs=1e-6)


def test_sizing_and_grids(spark):
    one = lambda c: values(spark, c, [(1,)], "i int")[0]
    assert one(X.kelly(F.lit(0.6), F.lit(2.0))) == pytest.approx(0.4) and one(X.kelly(F.lit(0.1), F.lit(1.0))) == 0
    assert one(X.confidence(F.lit(None).cast("double"))) == pytest.approx(0.65) and one(X.confidence(F.lit(9.0))) == pytest.approx(0.95)
    assert one(X.floor_to_step(F.lit(0.3), F.lit(0.1))) == pytest.approx(0.3) and one(X.volume_grid(F.lit(0.004), 0.01, 0.01, 5.0)) == 0
    assert one(X.risk_lots(F.lit(10_000.0), 0.01, F.lit(40.0))) == pytest.approx(2.5) and one(X.risk_lots(F.lit(1.0), 0.01, F.lit(0.0))) == 0
    assert one(X.bars_per_year(X.timeframe_minutes(F.lit("H4")))) == pytest.approx(252 * 6) and one(X.timeframe_minutes(F.lit("?"))) is None
    assert one(X.clip_parameter(F.lit(2.5), 0.0, 9.0, True)) == 2 and one(X.clip_parameter(F.lit(11.0), 0.0, 9.0, False)) == 9
    assert one(X.round_digits(F.lit(1.23456), F.lit(3))) == pytest.approx(1.235)
    assert one(X.position_pnl(F.lit(1.0), F.lit(1.5), F.lit(-1), F.lit(2.0), F.lit(10.0), F.lit(False))) == pytest.approx(-10.0)


def test_closed_market(spark):
    stamps = ["2024-01-05 21:59", "2024-01-05 22:00", "2024-01-06 00:30", "2024-01-06 01:00", "2024-01-07 21:00", "2024-01-07 22:00", "2024-01-08 04:59", "2024-01-08 05:00"]
    ts = F.col("t").cast("timestamp_ntz")
    rows = [(s,) for s in stamps]
    assert values(spark, X.weekend(ts), rows, "t string") == [False, True, True, True, True, False, False, False]
    assert values(spark, X.weekend_corrected(ts), rows, "t string") == [False, False, False, True, True, True, True, False]
    floor = values(spark, X.timeframe_floor(ts, 4 * 3600), rows, "t string")
    assert [f.hour for f in floor] == [20, 20, 0, 0, 20, 20, 4, 4]


def test_text_measures(spark):
    a, b = F.split(F.lit("a b c"), " "), F.split(F.lit("b c d"), " ")
    assert values(spark, TX.jaccard(a, b), [(1,)], "i int")[0] == pytest.approx(0.5)


def test_supertrend_by_hand():
    """Two bars of range 2 around 10, then a jump and a fall: with n = 1 and k = 1 the bands are the middle -+ the true range."""
    high, low, close = (np.array(x, dtype="f8") for x in ([11, 11, 21, 21, 11], [9, 9, 19, 19, 9], [10, 10, 20, 20, 10]))
    line, way = K.supertrend(high, low, close, n=1, k=1.0)
    # tr: 2, 2, 11, 2, 11; middle: 10, 10, 20, 20, 10
    assert way.tolist() == [1, 1, 1, 1, -1] and line[:4].tolist() == [8, 8, 9, 18]
    assert line[4] == 21  # the upper band: min(10 + 11, 22)


def test_sliding_limit_forgets_only_what_passed():
    assert K.sliding_limit(np.array([0, 1, 2, 3, 10, 10.5, 11.5]), 2, 10).tolist() == [True, True, False, False, True, False, True]


def test_hysteresis_keeps_its_state_over_missing_values():
    v = np.array([1, -9, np.nan, -1, 9, 9, 0.0])
    got = G.hysteresis(v, v <= -5, v >= 5, v >= 0, v <= 0)
    assert got.tolist() == [0, 1, 0, 1, 0, -1, 0]
