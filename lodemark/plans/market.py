"""Queries over bars: scans, cleaning, resampling, projections, rolling indicators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import rolling as R
from ..operators import bars as B
from ..sources import tables as T
from .base import BARS, DAYS, TICKS
from .registry import query


def parts():
    """Columns of a bar and the window of its series; made in a query, as columns need a session."""
    return (*(F.col(c) for c in ("high", "low", "close", "volume")), R.series("symbol"))


def r6(x):
    return F.round(x, 6)


@query(33, sql=f"""WITH {BARS}, u AS (
  SELECT symbol, ts, open, high, low, close, coalesce(volume, 0) AS volume FROM bars)
SELECT symbol, ts, open, high, low, close, volume FROM u WHERE open IS NOT NULL AND high IS NOT NULL AND low IS NOT NULL AND close IS NOT NULL""")
def bars_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical bars from text-typed, repeated rows: the last arrival of a bar wins."""
    bars = T.bars_1h(spark, sf_dir)
    raw = bars.select("symbol", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), *[F.col(c).cast("string").alias(c) for c in ("open", "high", "low", "close", "volume")])
    stale = raw.withColumn("close", F.lit("0.5"))
    both = stale.withColumn("seq", F.lit(0)).unionByName(raw.withColumn("seq", F.lit(1)))
    return B.normalise(both)


@query(34, sql=f"WITH {BARS} SELECT symbol, ts, close FROM bars WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-12 12:00:00'")
def bars_time_slice(spark, sf_dir):
    return T.bars_1h(spark, sf_dir).filter(F.col("ts").between(F.lit("2024-01-05").cast("timestamp_ntz"), F.lit("2024-01-12 12:00:00").cast("timestamp_ntz"))).select("symbol", "ts", "close")


@query(35, 375, sql=f"WITH {TICKS} SELECT symbol, last(price ORDER BY ts, seq) AS price FROM ticks GROUP BY symbol")
def latest_price(spark, sf_dir):
    return T.ticks(spark, sf_dir).groupBy("symbol").agg(F.max_by("price", F.struct("ts", "seq")).alias("price"))


@query(37, sql=f"""WITH {BARS}, t AS (SELECT * FROM bars QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) <= 60)
SELECT symbol, ts, close, CASE WHEN count(close) OVER w = 20 THEN round(avg(close) OVER w, 6) END AS sma_20
FROM t WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)""")
def tail_candles(spark, sf_dir):
    """The last 60 bars first, the indicator on those: its warm-up lies inside the tail."""
    _, _, C, _, W = parts()
    return B.tail(T.bars_1h(spark, sf_dir), 60).select("symbol", "ts", "close", r6(R.sma(C, 20, W)).alias("sma_20"))


@query(38, sql=f"""WITH {BARS}, l AS (SELECT symbol, ts, close, lag(close) OVER (PARTITION BY symbol ORDER BY ts) AS p FROM bars)
SELECT symbol, round(last(close ORDER BY ts), 2) AS last, round(last(close - p ORDER BY ts), 2) AS change, round(last(100 * (close - p) / p ORDER BY ts), 3) AS change_pct FROM l GROUP BY symbol""")
def market_payload(spark, sf_dir):
    _, _, C, _, W = parts()
    before = F.lag("close").over(W)
    rows = T.bars_1h(spark, sf_dir).select("symbol", "ts", "close", before.alias("p"))
    change = C - F.col("p")
    return rows.groupBy("symbol").agg(
        F.round(F.max_by("close", "ts"), 2).alias("last"), F.round(F.max_by(change, F.col("ts")), 2).alias("change"),
        F.round(F.max_by(100 * F.try_divide(change, F.col("p")), F.col("ts")), 3).alias("change_pct"),
    )


@query(39, 75, sql=f"""WITH {BARS}, t AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS k FROM bars QUALIFY k <= 24)
SELECT symbol, last(close ORDER BY ts) AS price, last(close ORDER BY ts) - first(close ORDER BY ts) AS change, max(high) AS high_24, min(low) AS low_24, round(0.0002 * last(close ORDER BY ts), 6) AS spread FROM t GROUP BY symbol""")
def cross_symbol_snapshot(spark, sf_dir):
    t = B.tail(T.bars_1h(spark, sf_dir), 24)
    return t.groupBy("symbol").agg(
        F.max_by("close", "ts").alias("price"), (F.max_by("close", "ts") - F.min_by("close", "ts")).alias("change"), F.max("high").alias("high_24"),
        F.min("low").alias("low_24"), r6(0.0002 * F.max_by("close", "ts")).alias("spread"),
    )


@query(79, sql=f"""WITH {TICKS}, k AS (SELECT *, to_timestamp(ceil(epoch_us(ts) / 14400000000.0) * 14400)::TIMESTAMP AS label FROM ticks)
SELECT symbol, label, first(price ORDER BY ts, seq) AS open, max(price) AS high, min(price) AS low, last(price ORDER BY ts, seq) AS close, sum(volume) AS volume, count(*) AS n FROM k GROUP BY symbol, label""")
def resample_4h_right(spark, sf_dir):
    """Right-closed, right-labelled buckets."""
    return B.resample_right(T.ticks(spark, sf_dir), 4 * 3600)


@query(80, 384, sql=f"WITH {BARS} SELECT symbol, ts, open, high, low, close, volume, n FROM bars")
def resample_1h_left(spark, sf_dir):
    return T.bars_1h(spark, sf_dir)


@query(81, 84, sql=f"WITH {DAYS} SELECT symbol, date, open, high, low, close, n, last_ts FROM days WHERE n >= 12")
def resample_1d(spark, sf_dir):
    """Calendar days with at least 12 ticks."""
    return T.bars_1d(spark, sf_dir).filter("n >= 12").select("symbol", "date", "open", "high", "low", "close", "n", "last_ts")


@query(82, sql=f"""WITH {DAYS} SELECT symbol, isoyear(date) AS iso_year, weekofyear(date) AS iso_week, min(date) AS week_start, first(open ORDER BY date) AS open,
max(high) AS high, min(low) AS low, last(close ORDER BY date) AS close, count(*) AS days FROM days GROUP BY 1, 2, 3""")
def resample_1w(spark, sf_dir):
    d = T.bars_1d(spark, sf_dir)
    return d.groupBy("symbol", F.expr("extract(yearofweek from date)").cast("long").alias("iso_year"), F.weekofyear("date").cast("long").alias("iso_week")).agg(
        F.min("date").alias("week_start"), F.min_by("open", "date").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
        F.max_by("close", "date").alias("close"), F.count("*").alias("days"),
    )



@query(83, sql=f"""WITH {TICKS} SELECT symbol, (ts + INTERVAL 1 HOUR)::DATE AS date, first(price ORDER BY ts, seq) AS open, max(price) AS high, min(price) AS low,
last(price ORDER BY ts, seq) AS close, count(*) AS m1_bars FROM ticks GROUP BY 1, 2""")
def resample_broker_day(spark, sf_dir):
    day = F.to_date(F.col("ts") + F.expr("INTERVAL 1 HOUR")).alias("date")
    return T.ticks(spark, sf_dir).groupBy("symbol", day).agg(*T.ohlcv()[:4], F.count("*").alias("m1_bars"))


@query(135, 137, 140, 155, sql=f"""WITH {BARS}, x AS (
  SELECT symbol, ts, close, count(close) OVER w AS k, avg(close) OVER w AS m, stddev_pop(close) OVER w AS s,
         {" + ".join(f"coalesce(lag(close, {i}) OVER o, 0) * {10 - i}" for i in range(1, 10))} + close * 10 AS wm, row_number() OVER o AS r
  FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), o AS (PARTITION BY symbol ORDER BY ts))
SELECT symbol, ts, CASE WHEN k = 20 THEN round(m, 6) END AS sma_20, CASE WHEN r >= 10 THEN round(wm / 55, 6) END AS wma_10,
       CASE WHEN k = 20 THEN round(m - 2 * s, 6) END AS bb_low, CASE WHEN k = 20 THEN round(m + 2 * s, 6) END AS bb_high,
       CASE WHEN k = 20 AND s <> 0 THEN round((close - m) / s, 6) END AS z_20 FROM x""")
def averages_and_bands(spark, sf_dir):
    _, _, C, _, W = parts()
    low, mid, high = R.bollinger(C, 20, 2.0, W)
    return T.bars_1h(spark, sf_dir).select(
        "symbol", "ts", r6(mid).alias("sma_20"), r6(R.wma(C, 10, W)).alias("wma_10"), r6(low).alias("bb_low"), r6(high).alias("bb_high"), r6(R.zscore(C, 20, W)).alias("z_20")
    )


@query(141, 146, 147, 153, 154, 158, sql=f"""WITH {BARS}, x AS (SELECT *, lag(close) OVER o AS p, lag(close, 10) OVER o AS p10,
  CASE WHEN lag(close) OVER o IS NULL THEN 0 ELSE sign(close - lag(close) OVER o) END AS sg FROM bars WINDOW o AS (PARTITION BY symbol ORDER BY ts))
SELECT symbol, ts, round(greatest(high - low, abs(high - p), abs(low - p)), 6) AS tr, round(100 * (close / p10 - 1), 6) AS roc_10, round(close - p10, 6) AS mom_10,
       round((close - p10) / p10, 6) AS rel_10, round(sum(sg * volume) OVER u, 6) AS obv,
       round(sum((high + low + close) / 3 * volume) OVER u / nullif(sum(volume) OVER u, 0), 6) AS vwap
FROM x WINDOW u AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def price_and_volume_indicators(spark, sf_dir):
    H, L, C, V, W = parts()
    u = W.rowsBetween(Window.unboundedPreceding, 0)
    b = T.bars_1h(spark, sf_dir).withColumn("sv", R.obv(C, V, W))
    return b.select(
        "symbol", "ts", r6(R.true_range(H, L, C, W)).alias("tr"), r6(R.roc(C, 10, W)).alias("roc_10"), r6(R.momentum(C, 10, W)).alias("mom_10"),
        r6(R.relative_momentum(C, 10, W)).alias("rel_10"), r6(F.sum("sv").over(u)).alias("obv"),
        r6(F.try_divide(F.sum((H + L + C) / 3 * V).over(u), F.sum(V).over(u))).alias("vwap"),
    )


@query(144, 145, sql=f"""WITH {BARS}, x AS (SELECT *, (high + low + close) / 3 AS tp,
  CASE WHEN count(*) OVER w = 14 THEN 100 * (close - min(low) OVER w) / nullif(max(high) OVER w - min(low) OVER w, 0) END AS raw
  FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 13 PRECEDING AND CURRENT ROW)),
k AS (SELECT *, CASE WHEN count(raw) OVER w3 = 3 THEN avg(raw) OVER w3 END AS k, CASE WHEN count(tp) OVER w20 = 20 THEN avg(tp) OVER w20 END AS m FROM x
  WINDOW w3 AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), w20 AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
d AS (SELECT *, abs(tp - m) AS dev FROM k)
SELECT symbol, ts, round(k, 6) AS stoch_k, CASE WHEN count(k) OVER w3 = 3 THEN round(avg(k) OVER w3, 6) END AS stoch_d,
       CASE WHEN count(dev) OVER w20 = 20 THEN round((tp - m) / nullif(0.015 * avg(dev) OVER w20, 0), 6) END AS cci_20
FROM d WINDOW w3 AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), w20 AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)""")
def stochastic_and_cci(spark, sf_dir):
    """CCI's deviation is the rolling mean of |tp - its average|, each at its own row."""
    _, _, _, _, W = parts()
    return B.stochastic_cci(T.bars_1h(spark, sf_dir), W).select("symbol", "ts", r6(F.col("k")).alias("stoch_k"), r6(F.col("d")).alias("stoch_d"), r6(F.col("cci")).alias("cci_20"))


@query(148, 150, 151, sql=f"""WITH {BARS}, x AS (SELECT *, count(*) OVER a AS na,
  list(high) OVER a AS hs, list(low) OVER a AS ls, max(high) OVER a AS hm, min(low) OVER a AS lm,
  max(high) OVER d AS dh, min(low) OVER d AS dl, count(*) OVER d AS nd,
  (max(high) OVER t9 + min(low) OVER t9) / 2 AS m9, (max(high) OVER t26 + min(low) OVER t26) / 2 AS m26, (max(high) OVER t52 + min(low) OVER t52) / 2 AS m52,
  row_number() OVER o AS r, lead(close, 26) OVER o AS chikou
  FROM bars WINDOW o AS (PARTITION BY symbol ORDER BY ts), a AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 25 PRECEDING AND CURRENT ROW),
  d AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), t9 AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 8 PRECEDING AND CURRENT ROW),
  t26 AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 25 PRECEDING AND CURRENT ROW), t52 AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 51 PRECEDING AND CURRENT ROW)),
y AS (SELECT *, CASE WHEN r >= 26 THEN (m9 + m26) / 2 END AS sa, CASE WHEN r >= 52 THEN m52 END AS sb FROM x)
SELECT symbol, ts, CASE WHEN na = 26 THEN round(100.0 * (list_position(hs, hm) - 1) / 25, 6) END AS aroon_up, CASE WHEN na = 26 THEN round(100.0 * (list_position(ls, lm) - 1) / 25, 6) END AS aroon_down,
  CASE WHEN nd = 20 THEN dh END AS dc_high, CASE WHEN nd = 20 THEN dl END AS dc_low, CASE WHEN nd = 20 THEN round((dh + dl) / 2, 6) END AS dc_mid,
  CASE WHEN r >= 9 THEN round(m9, 6) END AS tenkan, CASE WHEN r >= 26 THEN round(m26, 6) END AS kijun,
  round(lag(sa, 26) OVER o, 6) AS senkou_a, round(lag(sb, 26) OVER o, 6) AS senkou_b, chikou
FROM y WINDOW o AS (PARTITION BY symbol ORDER BY ts)""")
def channels_and_cloud(spark, sf_dir):
    """Aroon, Donchian and Ichimoku; chikou looks 26 bars ahead, so it is not causal."""
    H, L, _, _, W = parts()
    up, down = R.aroon(H, L, 25, W)
    top, bottom = R.donchian(H, L, 20, W)
    t, k = R.midpoint(H, L, 9, W), R.midpoint(H, L, 26, W)
    b = T.bars_1h(spark, sf_dir).select("symbol", "ts", "close", up.alias("up"), down.alias("down"), top.alias("dc_high"), bottom.alias("dc_low"), t.alias("t"), k.alias("k"), R.midpoint(H, L, 52, W).alias("b"))
    return b.select(
        "symbol", "ts", r6(F.col("up")).alias("aroon_up"), r6(F.col("down")).alias("aroon_down"), "dc_high", "dc_low", r6((F.col("dc_high") + F.col("dc_low")) / 2).alias("dc_mid"),
        r6(F.col("t")).alias("tenkan"), r6(F.col("k")).alias("kijun"), r6(F.lag((F.col("t") + F.col("k")) / 2, 26).over(W)).alias("senkou_a"),
        r6(F.lag("b", 26).over(W)).alias("senkou_b"), F.lead("close", 26).over(W).alias("chikou"),
    )


@query(156, 178, 179, 170, 171, sql=f"""WITH {BARS}, x AS (SELECT *, ln(close / lag(close) OVER o) AS lr, lead(close) OVER o AS nx, lead(close, 4) OVER o AS n4 FROM bars WINDOW o AS (PARTITION BY symbol ORDER BY ts))
SELECT symbol, ts, round(lr, 9) AS log_ret, CASE WHEN count(lr) OVER w = 20 THEN round(stddev_pop(lr) OVER w * sqrt(6048), 6) END AS realised_vol,
       CASE WHEN count(lr) OVER e = 50 THEN round(stddev_samp(lr) OVER e, 9) END AS vol_before, CASE WHEN nx IS NOT NULL THEN (nx > close)::INT END AS label, round(n4 / close - 1, 6) AS fwd_4
FROM x WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), e AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 50 PRECEDING AND 1 PRECEDING)""")
def returns_and_labels(spark, sf_dir):
    _, _, C, _, W = parts()
    b = T.bars_1h(spark, sf_dir).withColumn("lr", R.log_return(C, W))
    lr, nx = F.col("lr"), F.lead("close").over(W)
    return b.select(
        "symbol", "ts", F.round(lr, 9).alias("log_ret"), r6(R.rolling_std(lr, 20, W) * F.sqrt(F.lit(6048.0))).alias("realised_vol"),
        F.round(R.rolling_std(lr, 50, W, sample=True, upto=-1), 9).alias("vol_before"), F.when(nx.isNotNull(), (nx > C).cast("int")).alias("label"),
        r6(F.try_divide(F.lead("close", 4).over(W), C) - 1).alias("fwd_4"),
    )


@query(162, 163, sql=f"""WITH {BARS}, x AS (SELECT symbol, ts, high - low AS rng, row_number() OVER o AS r FROM bars WINDOW o AS (PARTITION BY symbol ORDER BY ts)),
q AS (SELECT *, quantile_cont(rng, 0.33) OVER w AS lo, quantile_cont(rng, 0.67) OVER w AS hi FROM x WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 99 PRECEDING AND CURRENT ROW))
SELECT symbol, ts, CASE WHEN r >= 100 THEN CASE WHEN rng < lo THEN 0 WHEN rng > hi THEN 2 ELSE 1 END END AS regime FROM q""")
def volatility_regime(spark, sf_dir):
    H, L, _, _, W = parts()
    w = W.rowsBetween(-99, 0)
    rng = H - L
    b = T.bars_1h(spark, sf_dir).select("symbol", "ts", rng.alias("rng"), F.percentile(rng, F.array(F.lit(0.33), F.lit(0.67))).over(w).alias("q"), F.row_number().over(W).alias("r"))
    level = F.when(F.col("rng") < F.get("q", F.lit(0)), 0).when(F.col("rng") > F.get("q", F.lit(1)), 2).otherwise(1)
    return b.select("symbol", "ts", F.when(F.col("r") >= 100, level).alias("regime"))


@query(173, 174, 175, 176, 177, 63, 371, sql=f"""WITH {BARS}, x AS (SELECT *, CASE WHEN count(close) OVER f = 5 THEN avg(close) OVER f END AS fast, CASE WHEN count(close) OVER s = 20 THEN avg(close) OVER s END AS slow,
  lag(close) OVER o AS p, row_number() OVER o AS r, CASE WHEN hour(ts) < 8 THEN high END AS mh FROM bars
  WINDOW o AS (PARTITION BY symbol ORDER BY ts), f AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), s AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
y AS (SELECT *, CASE WHEN fast > slow AND lag(fast) OVER o <= lag(slow) OVER o THEN 1 WHEN fast < slow AND lag(fast) OVER o >= lag(slow) OVER o THEN -1 ELSE 0 END AS cross_sig,
  CASE WHEN p < 100 AND close >= 100 THEN 1 ELSE 0 END AS over_100, max(mh) OVER (PARTITION BY symbol, ts::DATE) AS session_high FROM x WINDOW o AS (PARTITION BY symbol ORDER BY ts))
SELECT symbol, ts, cross_sig, over_100, coalesce(last_value(nullif(cross_sig, 0) IGNORE NULLS) OVER u, 0) AS held,
  last_value(nullif(cross_sig, 0) IGNORE NULLS) OVER l AS held_3, session_high,
  last_value(CASE WHEN close > session_high THEN 1 END IGNORE NULLS) OVER d AS broke_today,
  CASE WHEN r <= 20 THEN 0 ELSE cross_sig END AS warm
FROM y WINDOW u AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), l AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 3 PRECEDING AND CURRENT ROW),
  d AS (PARTITION BY symbol, ts::DATE ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def crossings_and_holds(spark, sf_dir):
    H, _, C, _, W = parts()
    day = F.to_date("ts")
    b = T.bars_1h(spark, sf_dir).select("symbol", "ts", "close", R.sma(C, 5, W).alias("fast"), R.sma(C, 20, W).alias("slow"), F.row_number().over(W).alias("r"),
        F.max(F.when(F.hour("ts") < 8, H)).over(Window.partitionBy("symbol", day)).alias("session_high"))
    fast, slow = F.col("fast"), F.col("slow")
    b = b.withColumn("cross_sig", R.crossover(fast, slow, W) - R.crossover(slow, fast, W)).withColumn("over_100", R.crossed_above(C, 100.0, W))
    in_day = Window.partitionBy("symbol", day).orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    broke = F.last(F.when(C > F.col("session_high"), 1), ignorenulls=True).over(in_day)
    return b.select("symbol", "ts", "cross_sig", "over_100", R.hold(F.col("cross_sig"), W).alias("held"), R.limited_fill(F.nullif("cross_sig", F.lit(0)), 3, W).alias("held_3"),
        "session_high", broke.alias("broke_today"), F.when(F.col("r") <= 20, 0).otherwise(F.col("cross_sig")).alias("warm"))
