"""Queries whose figures or work must not depend on the order or the number of the rows."""

import random
from decimal import Decimal

import comparison
import numpy as np
from pyspark.sql import functions as F

from lodemark import plans
from lodemark.operators import asof
from lodemark.operators import decisions as D
from lodemark.operators import quantiles as Q
from lodemark.operators import recurrence as K


def test_exposure_is_exact_to_the_cent(spark, sf_dir, tmp_path):
    """One price of nine trillion beside many cents, of which a sum of doubles would lose some."""
    spark.read.parquet(f"{sf_dir}/orders.parquet").write.parquet(str(tmp_path / "orders.parquet"))
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").limit(3000).coalesce(1)
    first = li.agg(F.min(F.struct("l_orderkey", "l_linenumber")).alias("k")).first().k
    big = (F.col("l_orderkey") == first[0]) & (F.col("l_linenumber") == first[1])
    li.withColumn("l_extendedprice", F.when(big, 9e12).otherwise(0.01)).sort(F.desc("l_extendedprice")).write.parquet(str(tmp_path / "lineitem.parquet"))
    got = plans.queries()["portfolio_exposure"](spark, str(tmp_path)).first()
    rows = spark.read.parquet(str(tmp_path / "lineitem.parquet")).select("l_returnflag", "l_extendedprice").collect()
    want = {}
    for r in rows:
        want[r[0]] = want.get(r[0], Decimal(0)) + Decimal(repr(r[1]))
    assert got.by_symbol == {k: float(v) for k, v in want.items()} and got.gross == float(sum(want.values()))


def test_quantiles_read_joined_trades(spark, sf_dir, monkeypatch):
    """The trades are joined once: what the rounds of the selection read holds no join."""
    read, whole = [], Q.exact_quantiles
    monkeypatch.setattr(Q, "exact_quantiles", lambda df, *rest: read.append(df._jdf.queryExecution().optimizedPlan().toString()) or whole(df, *rest))
    got = plans.queries()["risk_and_distribution"](spark, sf_dir)
    assert len(read) == 1 and "Join" not in read[0]
    assert comparison.differences(got, plans.oracle_sql()["risk_and_distribution"], sf_dir) == ""


def test_rate_limit_streams_users(spark, sf_dir):
    """No group a user reaches Python, and a log outlives the batches it is cut into."""
    assert "FlatMapGroupsInPandas" not in plans.queries()["sliding_rate_limit"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    r = random.Random(5)
    rows = [(r.choice([1, 1, 2, 3, None]), r.randrange(4000), i) for i in range(900)]
    df = spark.createDataFrame(rows, "u long, s long, i long").select("u", F.timestamp_seconds("s").cast("timestamp_ntz").alias("ts"), "s", "i").repartition(5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {x.i: x.accepted for x in K.sliding_limits(df, "u", 3, 60, ("ts", "i")).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {}
    for u in (1, 2, 3, None):
        hits = sorted((s, i) for v, s, i in rows if v == u)
        want |= dict(zip([i for _, i in hits], K.sliding_limit(np.array([s for s, _ in hits]), 3, 60).tolist(), strict=True))
    assert got == want


def test_lifecycle_streams_short_entities_and_spreads_long_ones(spark, monkeypatch):
    """Entities of up to `many` evaluations make no group each; both ways give the pass's states."""
    r, policy, groups = random.Random(9), D.Policy(trades=0, retire=9), []
    lists = {f"e{k}": [(d, round(r.uniform(-0.4, 1.2), 3), 9, 0.1) for d in sorted(r.randrange(90) for _ in range(n))] for k, n in enumerate([1, 3, 40, 50, 51, 120])}
    df = spark.createDataFrame([(k, *e, i) for k, v in lists.items() for i, e in enumerate(v)], "who string, day int, sharpe double, trades int, dd double, seq int").repartition(4)
    want = {k: list(D.replay(v, policy))[-1] for k, v in lists.items()}
    whole = D._by_buckets
    monkeypatch.setattr(D, "_by_buckets", lambda rows, *rest: groups.append(sorted(x[0] for x in rows.select("_by").distinct().collect())) or whole(rows, *rest))
    for many in (10_000, 50, 0):
        assert {x.who: (x.phase, x.since, x.good_runs, x.bad_runs) for x in D.lifecycle(df, "who", "day", policy, 8, many).collect()} == want
    assert groups == [["e4", "e5"], sorted(lists)]


def test_probes_of_hourly_bars_are_looked_up_by_hour(spark):
    """Both ways agree, on the hour, a microsecond beside it, past gaps and for tolerances that are no whole hours; and no probe is shuffled."""
    r = random.Random(3)
    bars = spark.createDataFrame([(s, 3600 * h, float(h)) for s in "ab" for h in range(60) if r.random() < 0.4], "symbol string, s long, close double").select("symbol", F.timestamp_seconds("s").cast("timestamp_ntz").alias("ts"), "close")
    times = [3_600_000_000 * r.randrange(60) + r.choice([-1, 0, 1, r.randrange(3_600_000_000)]) for _ in range(300)]
    probes = spark.createDataFrame([(i, r.choice(["a", "b", "z", None]), t) for i, t in enumerate(times)], "probe_id long, symbol string, t long").select("probe_id", "symbol", F.timestamp_micros("t").cast("timestamp_ntz").alias("probe_ts"))
    for seconds in (1800, 5400, 6 * 3600):
        one, two = (asof.forward_tolerance(probes, bars, seconds, ["close"], hourly=h) for h in (False, True))
        assert sorted(one.collect(), key=str) == sorted(two.collect(), key=str) and two.filter("close IS NOT NULL").count() > 10
        two.collect()
        assert "probe_id" not in "".join(x for x in two._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning" in x)
