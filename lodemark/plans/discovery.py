"""Queries of market observations, signals on bars, gaps and adversarial checks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import rolling as R
from ..operators import splits
from ..operators import stats as S
from ..sources import tables as T
from .base import BARS, DAYS
from .registry import query

_RET = f"""{BARS}, r AS (SELECT symbol, ts, open, high, low, close, row_number() OVER o AS k, ln(close / lag(close) OVER o) AS r FROM bars WINDOW o AS (PARTITION BY symbol ORDER BY ts))"""


def returns(spark, sf_dir):
    w = R.series("symbol")
    b = T.bars_1h(spark, sf_dir).select("symbol", "ts", "open", "high", "low", "close", F.row_number().over(w).alias("k"), R.log_return(F.col("close"), w).alias("r"))
    return b


@query(180, 182, 183, sql=f"""WITH {_RET}, g AS (SELECT symbol, avg(r) AS m, avg(abs(r)) AS ma, count(r) AS n, sum(r * r) - count(r) * avg(r) * avg(r) AS ss, sum(r * r) - count(r) * avg(abs(r)) * avg(abs(r)) AS ssa FROM r GROUP BY symbol),
l AS (SELECT unnest([1, 2, 3, 6, 12, 24]) AS lag), x AS (SELECT a.symbol, l.lag, sum((a.r - m) * (b.r - m)) / any_value(ss) AS ac, sum((abs(a.r) - ma) * (abs(b.r) - ma)) / any_value(ssa) AS ac_abs, any_value(n) AS n
  FROM r a CROSS JOIN l JOIN r b ON a.symbol = b.symbol AND b.k = a.k + l.lag JOIN g ON g.symbol = a.symbol GROUP BY 1, 2)
SELECT symbol, lag, round(ac, 6) AS ac, round(ac * sqrt(n), 3) AS t, round(ac_abs, 6) AS ac_abs FROM x""")
def return_autocorrelation(spark, sf_dir):
    """About the global mean, so not a Pearson correlation of the lagged pairs."""
    r = returns(spark, sf_dir)
    g = r.groupBy("symbol").agg(
        F.avg("r").alias("m"), F.avg(F.abs("r")).alias("ma"), F.count("r").alias("n"), (F.var_pop("r") * F.count("r")).alias("ss"), (F.var_pop(F.abs("r")) * F.count("r")).alias("ssa"))
    w = R.series("symbol")
    r = r.join(F.broadcast(g), "symbol")  # a row per symbol
    lags = (1, 2, 3, 6, 12, 24)
    r = r.withColumns({f"x{i}": F.lead("r", i).over(w) for i in lags})
    pairs = F.array(*[F.struct(F.lit(i).alias("lag"), F.col(f"x{i}").alias("x")) for i in lags])
    p = r.withColumn("p", F.explode(pairs)).select("symbol", "r", "m", "ma", "n", "ss", "ssa", "p.*")
    d = lambda x, m: x - F.col(m)
    ac = F.sum(d(F.col("r"), "m") * d(F.col("x"), "m")) / F.first("ss")
    ac_abs = F.sum(d(F.abs("r"), "ma") * d(F.abs("x"), "ma")) / F.first("ssa")
    return p.groupBy("symbol", "lag").agg(F.round(ac, 6).alias("ac"), F.round(ac * F.sqrt(F.first("n")), 3).alias("t"), F.round(ac_abs, 6).alias("ac_abs"))


@query(184, 291, 286, sql=f"""WITH {_RET}, s AS (SELECT *, sign(r) AS sg FROM r WHERE r IS NOT NULL), g AS (SELECT *, row_number() OVER o - row_number() OVER (PARTITION BY symbol, sg ORDER BY ts) AS isl, lead(r) OVER o AS nx FROM s WINDOW o AS (PARTITION BY symbol ORDER BY ts)),
l AS (SELECT *, row_number() OVER (PARTITION BY symbol, sg, isl ORDER BY ts) AS len FROM g)
SELECT symbol, len AS run, count(*) AS n, round(avg((nx > 0)::INT), 6) AS p_up, round(avg(-sg * nx), 6) AS fade FROM l WHERE nx IS NOT NULL AND len <= 4 AND sg <> 0 GROUP BY 1, 2""")
def trend_persistence(spark, sf_dir):
    """Place in a run of equal signs, against the next return."""
    w = R.series("symbol")
    s = returns(spark, sf_dir).filter("r is not null").withColumn("sg", F.signum("r")).withColumn("nx", F.lead("r").over(w))
    s = s.withColumn("new", F.when(F.col("sg").eqNullSafe(F.lag("sg").over(w)), 0).otherwise(1)).withColumn("isl", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    s = s.withColumn("run", F.row_number().over(Window.partitionBy("symbol", "isl").orderBy("ts")))
    s = s.filter((F.col("run") <= 4) & (F.col("sg") != 0) & F.col("nx").isNotNull())
    return s.groupBy("symbol", "run").agg(F.count("*").alias("n"), F.round(F.avg((F.col("nx") > 0).cast("int")), 6).alias("p_up"), F.round(F.avg(-F.col("sg") * F.col("nx")), 6).alias("fade"))


@query(185, 186, 288, 192, sql=f"""WITH {_RET}, v AS (SELECT *, CASE WHEN count(r) OVER w = 20 THEN stddev_samp(r) OVER w END AS s, lead(r) OVER o AS nx, sum(r) OVER f AS n4, count(r) OVER f AS k4 FROM r
  WINDOW o AS (PARTITION BY symbol ORDER BY ts), w AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), f AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING))
SELECT symbol, count(*) FILTER (abs(r / s) >= 2) AS shocks, round(avg(-sign(r) * nx) FILTER (abs(r / s) >= 2), 6) AS reversion, round(avg(sign(r) * n4) FILTER (k4 = 4), 6) AS continuation, round(kurtosis(r), 6) AS tails FROM v GROUP BY symbol""")
def shocks_and_tails(spark, sf_dir):
    w = R.series("symbol")
    r = F.col("r")
    ahead = w.rowsBetween(1, 4)
    v = returns(spark, sf_dir).select("symbol", "r", R.rolling_std(r, 20, w, sample=True, upto=-1).alias("s"), F.lead("r").over(w).alias("nx"), F.when(F.count(r).over(ahead) == 4, F.sum(r).over(ahead)).alias("n4"))
    shock = F.abs(r / F.col("s")) >= 2
    return v.groupBy("symbol").agg(
        F.count_if(shock).alias("shocks"), F.round(F.avg(F.when(shock, -F.signum(r) * F.col("nx"))), 6).alias("reversion"), F.round(F.avg(F.signum(r) * F.col("n4")), 6).alias("continuation"), F.round(S.kurtosis(r), 6).alias("tails"))


@query(187, 188, 283, sql=f"""WITH {_RET}, h AS (SELECT *, hour(ts) AS h FROM r) SELECT symbol, h AS hour, count(r) AS n, round(avg(r), 6) AS mean, round(avg(r) / (nullif(stddev_samp(r), 0) / sqrt(count(r))), 3) AS t,
  round(avg(high - low), 6) AS range_mean, round(avg(high - low) / avg(avg(high - low)) OVER (PARTITION BY symbol), 6) AS range_ratio FROM h GROUP BY 1, 2""")
def hour_of_day(spark, sf_dir):
    r = returns(spark, sf_dir).withColumn("range", F.col("high") - F.col("low"))
    g = r.groupBy("symbol", F.hour("ts").cast("long").alias("hour")).agg(F.count("r").alias("n"), F.round(F.avg("r"), 6).alias("mean"), F.round(S.t_stat(F.col("r")), 3).alias("t"), F.avg("range").alias("m"))
    ratio = F.col("m") / F.avg("m").over(Window.partitionBy("symbol"))
    return g.select("symbol", "hour", "n", "mean", "t", F.round("m", 6).alias("range_mean"), F.round(ratio, 6).alias("range_ratio"))


@query(189, 287, 284, 289, 292, sql=f"""WITH {_RET}, x AS (SELECT *, high - low AS rng, min(high - low) OVER w8 AS narrow, count(*) OVER w8 AS n8, lead(high - low) OVER o AS nr, lead(r) OVER o AS nx, max(high) OVER d AS dh, min(low) OVER d AS dl, count(*) OVER d AS nd FROM r
  WINDOW o AS (PARTITION BY symbol ORDER BY ts), w8 AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 7 PRECEDING AND CURRENT ROW), d AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)),
m AS (SELECT symbol, list_sort(list(rng))[count(*) // 2 + 1] AS med FROM x GROUP BY symbol)
SELECT symbol, count(*) FILTER (n8 = 8 AND rng <= narrow) AS nr, round(avg(nr / nullif(med, 0)) FILTER (n8 = 8 AND rng <= narrow), 6) AS expansion, count(*) FILTER (nd = 20 AND close > dh) AS up, count(*) FILTER (nd = 20 AND close < dl) AS down,
  round(avg(nx) FILTER (nd = 20 AND close > dh), 6) AS after_up FROM x JOIN m USING (symbol) GROUP BY symbol""")
def compression_and_breakout(spark, sf_dir):
    w = R.series("symbol")
    rng = F.col("high") - F.col("low")
    top, bottom = R.donchian(F.col("high"), F.col("low"), 20, w, upto=-1)
    b = returns(spark, sf_dir).withColumn("rng", rng)
    b = b.withColumns({"tight": F.coalesce(F.col("rng") <= R.full(F.col("rng"), F.min("rng").over(w.rowsBetween(-7, 0)), w, 8), F.lit(False)), "nr": F.lead("rng").over(w), "nx": F.lead("r").over(w), "up": F.col("close") > top, "down": F.col("close") < bottom})
    med = b.groupBy("symbol").agg(S.upper_median(F.col("rng")).alias("med"))
    return b.join(F.broadcast(med), "symbol").groupBy("symbol").agg(  # a row per symbol
        F.count_if("tight").alias("nr"), F.round(F.avg(F.when(F.col("tight"), F.try_divide(F.col("nr"), F.nullif("med", F.lit(0.0))))), 6).alias("expansion"), F.count_if("up").alias("up"), F.count_if("down").alias("down"),
        F.round(F.avg(F.when(F.col("up"), F.col("nx"))), 6).alias("after_up"),
    )


@query(190, 198, 167, 168, 169, sql=f"""WITH {BARS}, g AS (SELECT *, lag(ts) OVER o AS pt, lag(close) OVER o AS pc, min(low) OVER f AS lo, max(high) OVER f AS hi FROM bars WINDOW o AS (PARTITION BY symbol ORDER BY ts), f AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN CURRENT ROW AND 23 FOLLOWING))
SELECT symbol, pt AS gap_from, ts AS gap_to, date_diff('hour', pt, ts) - 1 AS gap_hours, lo <= pc AND hi >= pc AS filled,
  CASE WHEN date_diff('hour', pt, ts) - 1 > 12 THEN 'LONG' WHEN list_bool_or([isodow(pt + to_hours(i::INT)) >= 6 FOR i IN range(1, date_diff('hour', pt, ts))]) THEN 'WEEKEND' ELSE 'SOURCE_MISSING' END AS class
FROM g WHERE date_diff('hour', pt, ts) > 1""")
def gaps_and_fills(spark, sf_dir):
    """Missing hours between bars, their class, and whether the next 24 bars trade through the last close."""
    w = R.series("symbol")
    ahead = w.rowsBetween(0, 23)
    b = T.bars_1h(spark, sf_dir).select("symbol", "ts", F.lag("ts").over(w).alias("pt"), F.lag("close").over(w).alias("pc"), F.min("low").over(ahead).alias("lo"), F.max("high").over(ahead).alias("hi"))
    b = b.withColumn("gap", F.expr("timestampdiff(HOUR, pt, ts)")).filter("gap > 1")
    missing = F.sequence(F.col("pt") + F.expr("INTERVAL 1 HOUR"), F.col("ts") - F.expr("INTERVAL 1 HOUR"), F.expr("INTERVAL 1 HOUR"))
    kind = F.when(F.col("gap") - 1 > 12, "LONG").when(F.exists(missing, lambda t: F.weekday(t) >= 5), "WEEKEND").otherwise("SOURCE_MISSING")
    return b.select("symbol", F.col("pt").alias("gap_from"), F.col("ts").alias("gap_to"), (F.col("gap") - 1).alias("gap_hours"), ((F.col("lo") <= F.col("pc")) & (F.col("hi") >= F.col("pc"))).alias("filled"), kind.alias("class"))


@query(165, 166, 415, 417, 418, 116, sql=f"""WITH {BARS}, s AS (SELECT symbol, min(ts) AS a, max(ts) AS b FROM bars GROUP BY symbol), e AS (SELECT symbol, unnest(generate_series(a, b, INTERVAL 1 HOUR)) AS ts FROM s),
m AS (SELECT e.*, bars.ts IS NULL AS missing, isodow(e.ts) >= 6 AS weekend, e.ts >= TIMESTAMP '2024-01-15' AND e.ts < TIMESTAMP '2024-01-16' AS holiday FROM e LEFT JOIN bars USING (symbol, ts))
SELECT symbol, count(*) AS expected, count(*) FILTER (NOT missing) AS present, count(*) FILTER (missing AND weekend) AS weekend, count(*) FILTER (missing AND NOT weekend AND holiday) AS holiday, count(*) FILTER (missing AND NOT weekend AND NOT holiday) AS residual,
  round(count(*) FILTER (NOT missing) / count(*), 6) AS coverage FROM m GROUP BY symbol""")
def coverage_audit(spark, sf_dir):
    """The expected hourly grid against the bars; each missing hour is weekend, admitted holiday or residual."""
    b = T.bars_1h(spark, sf_dir).select("symbol", "ts")
    e = b.groupBy("symbol").agg(F.min("ts").alias("a"), F.max("ts").alias("z")).select("symbol", F.explode(F.sequence("a", "z", F.expr("INTERVAL 1 HOUR"))).alias("ts"))
    e = e.join(b.withColumn("here", F.lit(True)), ["symbol", "ts"], "left")
    missing, weekend = F.col("here").isNull(), F.weekday("ts") >= 5
    day = F.to_date("ts") == F.lit("2024-01-15").cast("date")
    return e.groupBy("symbol").agg(
        F.count("*").alias("expected"), F.count("here").alias("present"), F.count_if(missing & weekend).alias("weekend"), F.count_if(missing & ~weekend & day).alias("holiday"),
        F.count_if(missing & ~weekend & ~day).alias("residual"), F.round(F.count("here") / F.count("*"), 6).alias("coverage"),
    )


@query(181, 191, 327, sql=f"""WITH {_RET}, v AS (SELECT symbol, ts, r, high - low AS rng, lead(r) OVER (PARTITION BY symbol ORDER BY ts) AS nx FROM r WHERE r IS NOT NULL), c AS (SELECT symbol, list_sort(list(rng)) AS l, count(*) AS n FROM v GROUP BY symbol),
q AS (SELECT v.*, CASE WHEN rng <= l[n // 3 + 1] THEN 'low' WHEN rng <= l[2 * n // 3 + 1] THEN 'mid' ELSE 'high' END AS regime FROM v JOIN c USING (symbol))
SELECT symbol, regime, count(*) AS n, round(corr(r, nx), 6) AS ac, round(sum(r), 6) AS total FROM q GROUP BY 1, 2""")
def regime_autocorrelation(spark, sf_dir):
    """Terciles are elements of the sorted ranges (sorted[n // 3]), not interpolated."""
    w = R.series("symbol")
    v = returns(spark, sf_dir).filter("r is not null").withColumn("rng", F.col("high") - F.col("low")).withColumn("nx", F.lead("r").over(w))
    ranked = v.select("symbol", "rng", F.row_number().over(Window.partitionBy("symbol").orderBy("rng")).alias("i"), F.count("*").over(Window.partitionBy("symbol")).alias("n"))
    at = lambda m: F.max(F.when(F.col("i") == F.floor(m * F.col("n") / 3) + 1, F.col("rng")))
    cuts = ranked.groupBy("symbol").agg(at(1).alias("a"), at(2).alias("b"))
    regime = F.when(F.col("rng") <= F.col("a"), "low").when(F.col("rng") <= F.col("b"), "mid").otherwise("high")
    return v.join(F.broadcast(cuts), "symbol").groupBy("symbol", regime.alias("regime")).agg(F.count("*").alias("n"), F.round(F.corr("r", "nx"), 6).alias("ac"), F.round(F.sum("r"), 6).alias("total"))


@query(193, 290, 285, 282, 407, sql=f"""WITH {_RET}, x AS (SELECT *, sign(lag(close, 1) OVER o - lag(close, 24) OVER o) AS trend, CASE WHEN sign(r) = sign(lag(r, 1) OVER o) AND sign(r) = sign(lag(r, 2) OVER o) THEN sign(r) ELSE 0 END AS streak, lead(close, 6) OVER o / close - 1 AS fwd FROM r WINDOW o AS (PARTITION BY symbol ORDER BY ts))
SELECT symbol, count(*) FILTER (streak <> 0) AS streaks, count(*) FILTER (streak <> 0 AND trend = -streak) AS aligned, round(avg(-streak * fwd) FILTER (streak <> 0 AND trend = -streak), 6) AS mean, avg(-streak * fwd) FILTER (streak <> 0) > 0 AS positive FROM x GROUP BY symbol""")
def multi_timeframe_streaks(spark, sf_dir):
    """A three-bar streak faded where the day's trend points the other way."""
    w = R.series("symbol")
    sg = F.signum("r")
    streak = F.when((sg == F.signum(F.lag("r", 1).over(w))) & (sg == F.signum(F.lag("r", 2).over(w))), sg).otherwise(0.0)
    x = returns(spark, sf_dir).select("symbol", F.signum(F.lag("close", 1).over(w) - F.lag("close", 24).over(w)).alias("trend"), streak.alias("s"), (F.lead("close", 6).over(w) / F.col("close") - 1).alias("fwd"))
    on, along = F.col("s") != 0, (F.col("s") != 0) & (F.col("trend") == -F.col("s"))
    gain = -F.col("s") * F.col("fwd")
    return x.groupBy("symbol").agg(F.count_if(on).alias("streaks"), F.count_if(along).alias("aligned"), F.round(F.avg(F.when(along, gain)), 6).alias("mean"), (F.avg(F.when(on, gain)) > 0).alias("positive"))


_NETS = f"""{_RET}, t AS (SELECT symbol, ts, -sign(r) * (lead(close, 4) OVER o / close - 1) AS gross FROM r WINDOW o AS (PARTITION BY symbol ORDER BY ts)), n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS k, count(*) OVER (PARTITION BY symbol) AS len FROM t WHERE gross IS NOT NULL)"""


def fade_trades(spark, sf_dir):
    w = R.series("symbol")
    t = returns(spark, sf_dir).select("symbol", "ts", (-F.signum("r") * (F.lead("close", 4).over(w) / F.col("close") - 1)).alias("gross"))
    return t.filter("gross is not null")


@query(321, 324, 411, sql=f"""WITH {_NETS}, b AS (SELECT *, least(floor((k - 1) / nullif(floor(len / 4), 0)), 3)::INT AS block FROM n), p AS (SELECT symbol, block, sum(gross) AS s FROM b GROUP BY 1, 2),
c AS (SELECT symbol, m, avg(gross - m * 0.00085) AS net FROM n, (VALUES (1.0), (1.5), (2.0), (3.0)) c(m) GROUP BY 1, 2)
SELECT c.symbol, round(max(net) FILTER (m = 1), 6) AS base, round(max(net) FILTER (m = 1.5), 6) AS x15, round(max(net) FILTER (m = 2), 6) AS x2, round(max(net) FILTER (m = 3), 6) AS x3, any_value(pos) AS positive_blocks, (max(net) FILTER (m = 2) > 0 AND any_value(pos) >= 3) AS survives
FROM c JOIN (SELECT symbol, count(*) FILTER (s > 0) AS pos FROM p GROUP BY symbol) q USING (symbol) GROUP BY c.symbol""")
def adversarial_costs_and_blocks(spark, sf_dir):
    """Cost shocks as a crossed attack table, and four blocks of which the last takes the remainder; only costs up to 2x are fatal."""
    t = fade_trades(spark, sf_dir)
    w = R.series("symbol")
    t = t.withColumns({"k": F.row_number().over(w), "len": F.count("*").over(Window.partitionBy("symbol"))})
    t = t.withColumn("block", F.least(F.floor(F.try_divide(F.col("k") - 1, F.floor(F.col("len") / 4))), F.lit(3)))
    blocks = t.groupBy("symbol", "block").agg(F.sum("gross").alias("s")).groupBy("symbol").agg(F.count_if(F.col("s") > 0).alias("positive_blocks"))
    g = t.groupBy("symbol").agg(*[F.avg(F.col("gross") - m * 0.00085).alias(n) for n, m in (("base", 1.0), ("x15", 1.5), ("x2", 2.0), ("x3", 3.0))]).join(blocks, "symbol")
    return g.select("symbol", *[F.round(n, 6).alias(n) for n in ("base", "x15", "x2", "x3")], "positive_blocks", ((F.col("x2") > 0) & (F.col("positive_blocks") >= 3)).alias("survives"))


@query(315, sql=f"""WITH {_RET}, x AS (SELECT symbol, r, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS i, count(*) OVER (PARTITION BY symbol) AS len FROM r WHERE r IS NOT NULL), b AS (SELECT symbol, floor(i / floor(len / 4))::INT AS block, r FROM x),
s AS (SELECT symbol, block, count(*) AS n, sum(r) AS s, sum(r * r) AS q FROM b WHERE block < 4 GROUP BY 1, 2), c AS (SELECT * FROM (VALUES (0, [0, 1]), (1, [0, 2]), (2, [0, 3]), (3, [1, 2]), (4, [1, 3]), (5, [2, 3])) c(combo, ins)),
g AS (SELECT combo, symbol, sum(n) FILTER (list_contains(ins, block)) AS ni, sum(s) FILTER (list_contains(ins, block)) AS si, sum(q) FILTER (list_contains(ins, block)) AS qi, sum(n) FILTER (NOT list_contains(ins, block)) AS no, sum(s) FILTER (NOT list_contains(ins, block)) AS so, sum(q) FILTER (NOT list_contains(ins, block)) AS qo FROM c, s GROUP BY 1, 2),
h AS (SELECT combo, symbol, round(si / ni / sqrt((qi - si * si / ni) / (ni - 1)), 12) AS a, round(so / no / sqrt((qo - so * so / no) / (no - 1)), 12) AS b FROM g),
k AS (SELECT *, row_number() OVER (PARTITION BY combo ORDER BY b, symbol) AS rank, count(*) OVER (PARTITION BY combo) AS m, row_number() OVER (PARTITION BY combo ORDER BY a DESC, symbol) AS best FROM h), l AS (SELECT ln((rank / (m + 1)) / (1 - rank / (m + 1))) AS logit FROM k WHERE best = 1)
SELECT count(*) AS combos, round(avg((logit <= 0)::INT), 6) AS pbo, round(avg(logit), 6) AS mean_logit FROM l""")
def backtest_overfitting(spark, sf_dir):
    r = returns(spark, sf_dir).filter("r is not null")
    return splits.overfitting(r, "symbol", ["ts"], "r", 4)


@query(400, 402, sql=f"""WITH {_RET}, o AS (SELECT symbol, avg(sign(r) * sign(p)) AS edge, avg(r * p) / nullif(var_pop(r), 0) * sqrt(count(*)) AS t FROM (SELECT *, lag(r) OVER (PARTITION BY symbol ORDER BY ts) AS p FROM r) WHERE p IS NOT NULL GROUP BY symbol),
h AS (SELECT symbol, k, 2 * abs(edge) * 0.00085 * k AS gross, t FROM o, (VALUES (2), (3), (4)) v(k)), e AS (SELECT *, gross / 0.0006 AS evc FROM h)
SELECT symbol, k, round(evc, 6) AS evc, CASE WHEN evc < 0.25 THEN 'REJECTED' WHEN evc >= 1 THEN 'VIABLE' ELSE 'WEAK' END AS status, round(abs(t) * least(evc, 3) / k, 6) AS priority FROM e""")
def hypothesis_emission(spark, sf_dir):
    """Observations crossed with run lengths; effect over cost decides and ranks."""
    w = R.series("symbol")
    r = returns(spark, sf_dir).withColumn("p", F.lag("r").over(w)).filter("p is not null")
    o = r.groupBy("symbol").agg(F.avg(F.signum("r") * F.signum("p")).alias("edge"), (F.avg(F.col("r") * F.col("p")) / F.nullif(F.var_pop("r"), F.lit(0.0)) * F.sqrt(F.count("*"))).alias("t"))
    h = o.withColumn("k", F.explode(F.array(F.lit(2), F.lit(3), F.lit(4)))).withColumn("evc", 2 * F.abs("edge") * 0.00085 * F.col("k") / 0.0006)
    status = F.when(F.col("evc") < 0.25, "REJECTED").when(F.col("evc") >= 1, "VIABLE").otherwise("WEAK")
    return h.select("symbol", "k", F.round("evc", 6).alias("evc"), status.alias("status"), F.round(F.abs("t") * F.least("evc", F.lit(3.0)) / F.col("k"), 6).alias("priority"))


@query(126, sql=f"""WITH {DAYS}, x AS (SELECT symbol, date, close, close / lag(close, 5) OVER o - 1 AS prior, lead(close, 1) OVER o / close - 1 AS nx FROM days WINDOW o AS (PARTITION BY symbol ORDER BY date)),
j AS (SELECT a.symbol, b.symbol AS other, a.nx, b.prior FROM x a JOIN x b ON a.date = b.date AND a.symbol <> b.symbol WHERE a.nx IS NOT NULL AND b.prior IS NOT NULL)
SELECT symbol, other, prior > 0 AS other_rose, count(*) AS n, round(avg(nx), 6) AS mean, (count(*) >= 10 AND avg(nx) > 0) AS passes FROM j GROUP BY 1, 2, 3""")
def conditional_split(spark, sf_dir):
    """Daily results split by the prior return of each other symbol."""
    w = Window.partitionBy("symbol").orderBy("date")
    x = T.bars_1d(spark, sf_dir).select("symbol", "date", (F.col("close") / F.lag("close", 5).over(w) - 1).alias("prior"), (F.lead("close").over(w) / F.col("close") - 1).alias("nx"))
    other = x.select(F.col("symbol").alias("other"), "date", F.col("prior").alias("op"))
    j = x.join(other, "date").filter((F.col("symbol") != F.col("other")) & F.col("nx").isNotNull() & F.col("op").isNotNull())
    return j.groupBy("symbol", "other", (F.col("op") > 0).alias("other_rose")).agg(F.count("*").alias("n"), F.round(F.avg("nx"), 6).alias("mean"), ((F.count("*") >= 10) & (F.avg("nx") > 0)).alias("passes"))
