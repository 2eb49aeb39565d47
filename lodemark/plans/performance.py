"""Queries of trade, equity and calibration statistics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import quantiles as Q
from ..operators import stats as S
from ..operators.chains import cut_lineage
from ..sources import tables as T
from .base import BARS, TRADES
from .registry import query

_PF = "CASE WHEN coalesce(abs(sum(@x) FILTER (@x < 0)), 0) = 0 THEN 999 ELSE coalesce(sum(@x) FILTER (@x > 0), 0) / abs(sum(@x) FILTER (@x < 0)) END"
_STATS = f"""count(pnl) AS n, round(avg(pnl), 6) AS mean, round(avg(pnl) / (nullif(stddev_samp(pnl), 0) / sqrt(count(pnl))), 3) AS t,
  round({_PF.replace("@x", "pnl")}, 3) AS pf, round(avg((pnl > 0)::INT), 4) AS win_rate, round(sum(pnl), 4) AS total"""
ORDER = ["exit_ts", "orderkey", "line"]


@query(85, 87, 88, 89, 125, 127, sql=f"WITH {TRADES} SELECT strategy, regime, year(exit_ts) AS year, {_STATS} FROM trades GROUP BY ALL")
def trade_stats(spark, sf_dir):
    return S.trade_stats(T.trades(spark, sf_dir).withColumn("year", F.year("exit_ts").cast("long")), ["strategy", "regime", "year"])


@query(86, sql=f"""WITH {TRADES} SELECT strategy, {_STATS}, round(sum(pnl + cost), 4) AS gross, round(sum(cost), 4) AS cost,
  list_sort(list(hold_days))[count(*) // 2 + 1] AS median_hold FROM trades GROUP BY strategy""")
def daily_trade_stats(spark, sf_dir):
    """Median hold is an element of the counted distribution, so a hot strategy is counted per value, not collected."""
    t = T.trades(spark, sf_dir)
    base = S.trade_stats(t, ["strategy"], more=(F.round(F.sum(F.col("pnl") + F.col("cost")), 4).alias("gross"), F.round(F.sum("cost"), 4).alias("cost")))
    counts = t.groupBy("strategy", "hold_days").agg(F.count("*").alias("k"))
    w = Window.partitionBy("strategy")
    counts = counts.withColumn("upto", F.sum("k").over(w.orderBy("hold_days"))).withColumn("n", F.sum("k").over(w))
    median = counts.filter(F.col("upto") > F.floor(F.col("n") / 2)).groupBy("strategy").agg(F.min("hold_days").cast("long").alias("median_hold"))
    return base.join(median, "strategy")


@query(90, 92, 93, 98, 99, 100, 106, 110, sql=f"""WITH {TRADES}, v AS (SELECT strategy, quantile_cont(pnl, 0.05) AS q FROM trades GROUP BY strategy)
SELECT strategy, round(CASE WHEN stddev_samp(pnl) > 1e-12 THEN avg(pnl) / stddev_samp(pnl) * sqrt(252) ELSE 0 END, 6) AS sharpe,
  round(avg(pnl) / sqrt(avg(pnl * pnl) FILTER (pnl < 0)) * sqrt(252), 6) AS sortino, round(quantile_cont(pnl, 0.95) / abs(quantile_cont(pnl, 0.05)), 6) AS tail_ratio,
  round(abs(least(quantile_cont(pnl, 0.05), 0)), 6) AS var_95, round(avg(pnl) FILTER (pnl <= q), 6) AS cvar_95, round(skewness(pnl), 6) AS skew, round(kurtosis(pnl), 6) AS kurt,
  min(pnl) AS low, round(median(pnl), 6) AS mid, max(pnl) AS high, round(quantile_cont(pnl, 0.25), 6) AS p25, round(quantile_cont(pnl, 0.75), 6) AS p75, round(quantile_cont(pnl, 0.9), 6) AS p90
FROM trades JOIN v USING (strategy) GROUP BY strategy""")
def risk_and_distribution(spark, sf_dir):
    """Quantiles by distributed selection, everything else from one pass over the trades, which are joined once for all passes."""
    t, x = cut_lineage(T.trades(spark, sf_dir).select("strategy", "pnl")), F.col("pnl")
    q = F.broadcast(Q.exact_quantiles(t, ["strategy"], "pnl", [0.05, 0.25, 0.5, 0.75, 0.9, 0.95]))  # a row a strategy
    r = lambda c, name: F.round(c, 6).alias(name)
    p = dict(zip(("p5", "p25", "mid", "p75", "p90", "p95"), (F.col("quantiles")[i] for i in range(6)), strict=True))
    first = [F.first(c).alias(k) for k, c in p.items()]
    got = t.join(q, "strategy").groupBy("strategy").agg(
        r(S.sharpe(x, 252.0), "sharpe"), r(S.sortino(x, 252.0), "sortino"), r(F.avg(F.when(x <= p["p5"], x)), "cvar_95"), r(S.skewness(x), "skew"), r(S.kurtosis(x), "kurt"),
        F.min(x).alias("low"), F.max(x).alias("high"), F.count(x).alias("n"), *first,
    )
    tail = F.when(F.col("n") >= 20, F.try_divide("p95", F.abs("p5")))
    var = F.when(F.col("n") >= 5, F.abs(F.least("p5", F.lit(0.0))))
    return got.select("strategy", "sharpe", "sortino", r(tail, "tail_ratio"), r(var, "var_95"), "cvar_95", "skew", "kurt", "low", r(F.col("mid"), "mid"), "high", *[r(F.col(c), c) for c in ("p25", "p75", "p90")])


_CURVE = f"""{TRADES}, d AS (SELECT strategy, exit_ts, sum(pnl) AS pnl FROM trades GROUP BY 1, 2),
c AS (SELECT strategy, exit_ts, 1000000 + round(sum(pnl) OVER (PARTITION BY strategy ORDER BY exit_ts), 4) AS equity FROM d),
p AS (SELECT *, max(equity) OVER (PARTITION BY strategy ORDER BY exit_ts) AS peak FROM c)"""


def equity_curve(spark, sf_dir):
    """Daily equity of each strategy: trades are first summed per day, so a busy strategy is a short series."""
    daily = T.trades(spark, sf_dir).groupBy("strategy", "exit_ts").agg(F.sum("pnl").alias("pnl"))
    w = Window.partitionBy("strategy").orderBy("exit_ts")
    return daily.select("strategy", "exit_ts", (1000000 + F.round(F.sum("pnl").over(w.rowsBetween(Window.unboundedPreceding, 0)), 4)).alias("equity"))


@query(94, 95, 388, sql=f"WITH {_CURVE} SELECT strategy, exit_ts, equity, round((peak - equity) / nullif(peak, 0), 6) AS dd, round(peak - equity, 4) AS dd_abs FROM p")
def drawdown_series(spark, sf_dir):
    got = S.drawdowns(equity_curve(spark, sf_dir), Window.partitionBy("strategy").orderBy("exit_ts"))
    return got.select("strategy", "exit_ts", "equity", F.round("dd", 6).alias("dd"), F.round("dd_abs", 4).alias("dd_abs"))


@query(91, 96, 97, 104, sql=f"""WITH {_CURVE}, f AS (SELECT *, (peak - equity) / nullif(peak, 0) AS dd, row_number() OVER o - sum((equity < peak)::INT) OVER o AS g, equity < peak AS under
  FROM p WINDOW o AS (PARTITION BY strategy ORDER BY exit_ts)),
g AS (SELECT strategy, g, count(*) FILTER (under) AS k FROM f GROUP BY 1, 2), m AS (SELECT strategy, max(k) AS longest_under FROM g GROUP BY 1)
SELECT strategy, round(max(dd), 6) AS max_dd, round(max(peak - equity), 4) AS max_dd_abs, round(sqrt(avg(10000 * dd * dd)), 6) AS ulcer, any_value(longest_under) AS longest_under,
  last(equity ORDER BY exit_ts) AS final FROM f JOIN m USING (strategy) GROUP BY strategy""")
def drawdown_summary(spark, sf_dir):
    w = Window.partitionBy("strategy").orderBy("exit_ts")
    got = S.drawdowns(equity_curve(spark, sf_dir), w)
    runs = S.islands(got, F.col("equity") < F.col("peak"), ["strategy"], ["exit_ts"])
    longest = runs.groupBy("strategy").agg(F.coalesce(F.max(F.when(F.col("value"), F.col("length"))), F.lit(0)).alias("longest_under"))
    base = got.groupBy("strategy").agg(
        F.round(F.max("dd"), 6).alias("max_dd"), F.round(F.max("dd_abs"), 4).alias("max_dd_abs"), F.round(F.sqrt(F.avg(10000 * F.col("dd") * F.col("dd"))), 6).alias("ulcer"),
        F.max_by("equity", "exit_ts").alias("final"),
    )
    return base.join(longest, "strategy")


@query(105, sql=f"""WITH {TRADES}, d AS (SELECT strategy, exit_ts, sign(round(sum(pnl), 4)) AS s FROM trades GROUP BY 1, 2),
g AS (SELECT *, row_number() OVER o - row_number() OVER (PARTITION BY strategy, s ORDER BY exit_ts) AS g FROM d WINDOW o AS (PARTITION BY strategy ORDER BY exit_ts)),
k AS (SELECT strategy, s, g, count(*) AS k FROM g GROUP BY 1, 2, 3)
SELECT strategy, coalesce(max(k) FILTER (s > 0), 0) AS win_streak, coalesce(max(k) FILTER (s < 0), 0) AS loss_streak FROM k GROUP BY strategy""")
def streaks(spark, sf_dir):
    """Longest runs of winning and losing days; a day at zero breaks both."""
    d = T.trades(spark, sf_dir).groupBy("strategy", "exit_ts").agg(F.signum(F.round(F.sum("pnl"), 4)).alias("s"))
    runs = S.islands(d, F.col("s"), ["strategy"], ["exit_ts"])
    best = lambda sign: F.coalesce(F.max(F.when(F.signum("value") == sign, F.col("length"))), F.lit(0))
    return runs.groupBy("strategy").agg(best(1).alias("win_streak"), best(-1).alias("loss_streak"))


@query(107, 109, sql=f"""WITH {TRADES}, b AS (SELECT *, CASE WHEN hold_days <= 20 THEN '00-20' WHEN hold_days <= 40 THEN '21-40' WHEN hold_days <= 60 THEN '41-60' WHEN hold_days <= 90 THEN '61-90' WHEN hold_days <= 120 THEN '91-120' ELSE '121+' END AS bucket FROM trades)
SELECT bucket, regime AS exit_reason, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 4) AS share, round(avg((pnl > 0)::INT), 4) AS win_rate, round(avg(pnl), 4) AS mean FROM b GROUP BY 1, 2""")
def exit_and_holding_buckets(spark, sf_dir):
    h, x = F.col("hold_days"), F.col("pnl")
    bucket = F.when(h <= 20, "00-20").when(h <= 40, "21-40").when(h <= 60, "41-60").when(h <= 90, "61-90").when(h <= 120, "91-120").otherwise("121+")
    g = T.trades(spark, sf_dir).groupBy(bucket.alias("bucket"), F.col("regime").alias("exit_reason")).agg(
        F.count("*").alias("n"), F.round(S.win_rate(x), 4).alias("win_rate"), F.round(F.avg(x), 4).alias("mean"))
    return g.withColumn("share", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()), 4))  # at most 30 groups


@query(108, sql=f"""WITH {TRADES}, c AS (SELECT *, CASE WHEN pnl >= 0 THEN 'winner' WHEN cost > -pnl THEN 'cost_loss' WHEN hold_days <= 30 THEN 'quick_loss' ELSE 'slow_loss' END AS class FROM trades)
SELECT strategy, class, count(*) AS n, round(corr(cost, notional), 6) AS corr_mfe_mae FROM c GROUP BY 1, 2""")
def loss_classes(spark, sf_dir):
    x = F.col("pnl")
    kind = F.when(x >= 0, "winner").when(F.col("cost") > -x, "cost_loss").when(F.col("hold_days") <= 30, "quick_loss").otherwise("slow_loss")
    return T.trades(spark, sf_dir).groupBy("strategy", kind.alias("class")).agg(F.count("*").alias("n"), F.round(F.corr("cost", "notional"), 6).alias("corr_mfe_mae"))


@query(103, sql=f"""WITH {TRADES} SELECT strategy, regime, count(*) AS trades, count(*) FILTER (pnl > 0) AS wins, round(sum(pnl) FILTER (pnl > 0), 4) AS gross_profit, round(sum(pnl) FILTER (pnl < 0), 4) AS gross_loss,
  round(avg(pnl) FILTER (pnl > 0) / abs(avg(pnl) FILTER (pnl < 0)), 6) AS payoff, round(CASE WHEN count(*) FILTER (pnl < 0) > 1 THEN avg(pnl) / stddev_samp(pnl) FILTER (pnl < 0) END, 6) AS sortino_neg,
  round(avg(pnl), 6) AS expectancy FROM trades GROUP BY 1, 2""")
def economic_metrics(spark, sf_dir):
    """Undefined figures are null, not 0; this Sortino divides by the sample deviation of the negatives."""
    x = F.col("pnl")
    win, loss = F.when(x > 0, x), F.when(x < 0, x)
    return T.trades(spark, sf_dir).groupBy("strategy", "regime").agg(
        F.count("*").alias("trades"), F.count(win).alias("wins"), F.round(F.sum(win), 4).alias("gross_profit"), F.round(F.sum(loss), 4).alias("gross_loss"),
        F.round(F.try_divide(F.avg(win), F.abs(F.avg(loss))), 6).alias("payoff"), F.round(F.try_divide(F.avg(x), F.stddev_samp(loss)), 6).alias("sortino_neg"), F.round(F.avg(x), 6).alias("expectancy"),
    )


@query(111, 208, 197, sql=f"""WITH {TRADES}, w AS (SELECT *, (dense_rank() OVER (ORDER BY year(exit_ts) * 12 + month(exit_ts)) - 1) // 3 AS win FROM trades),
a AS (SELECT win, round(sum(pnl), 4) AS net, count(*) AS n FROM w GROUP BY win), r AS (SELECT *, row_number() OVER (ORDER BY abs(net) DESC, win) AS k FROM a)
SELECT count(*) AS windows, round(avg((net > 0)::INT), 6) AS positive, round(avg(net), 4) AS mean, round(median(net), 4) AS median, round(stddev_samp(net), 4) AS std,
  round(sum(abs(net)) FILTER (k = 1) / sum(abs(net)), 6) AS top1, round(sum(abs(net)) FILTER (k <= 5) / sum(abs(net)), 6) AS top5, round(corr(win, net), 6) AS time_corr,
  arg_min(win, net) AS worst, arg_max(win, net) AS best FROM r""")
def walk_forward_windows(spark, sf_dir):
    """Months are ranked on their distinct values, a small table, and joined back."""
    t = T.trades(spark, sf_dir).withColumn("m", F.year("exit_ts") * 12 + F.month("exit_ts"))
    by_month = t.groupBy("m").agg(F.sum("pnl").alias("net"), F.count("*").alias("n"))
    by_month = by_month.withColumn("win", F.floor((F.dense_rank().over(Window.partitionBy().orderBy("m")) - 1) / 3))
    a = by_month.groupBy("win").agg(F.round(F.sum("net"), 4).alias("net"))
    a = a.withColumn("k", F.row_number().over(Window.partitionBy().orderBy(F.desc(F.abs("net")), "win")))
    size = F.abs("net")
    return a.agg(
        F.count("*").alias("windows"), F.round(F.avg((F.col("net") > 0).cast("int")), 6).alias("positive"), F.round(F.avg("net"), 4).alias("mean"), F.round(F.percentile("net", 0.5), 4).alias("median"),
        F.round(F.stddev_samp("net"), 4).alias("std"), F.round(F.sum(F.when(F.col("k") == 1, size)) / F.sum(size), 6).alias("top1"), F.round(F.sum(F.when(F.col("k") <= 5, size)) / F.sum(size), 6).alias("top5"),
        F.round(F.corr("win", "net"), 6).alias("time_corr"), F.min_by("win", "net").alias("worst"), F.max_by("win", "net").alias("best"),
    )


@query(112, sql="""WITH p AS (SELECT quality::INT AS y, (n_chars % 101) / 100.0 AS c FROM labels JOIN documents USING (doc_id)),
b AS (SELECT *, least(floor(c * 10), 9)::INT AS bin FROM p)
SELECT bin, count(*) AS n, round(avg(c), 6) AS predicted, round(avg(y), 6) AS observed, round(count(*) / sum(count(*)) OVER () * abs(avg(c) - avg(y)), 6) AS ece_part, round(avg((c - y) * (c - y)), 6) AS brier FROM b GROUP BY bin""")
def calibration(spark, sf_dir):
    """Ten equal bins, the last closed; ECE is the sum of ece_part."""
    p = T.table(spark, sf_dir, "labels").join(T.table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    c, y = F.col("c"), F.col("quality")
    p = p.withColumn("c", (F.col("n_chars") % 101) / 100.0)
    g = p.groupBy(F.least(F.floor(c * 10), F.lit(9)).cast("int").alias("bin")).agg(
        F.count("*").alias("n"), F.avg(c).alias("p"), F.avg(y).alias("o"), F.round(F.avg((c - y) * (c - y)), 6).alias("brier"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy())
    return g.select("bin", "n", F.round("p", 6).alias("predicted"), F.round("o", 6).alias("observed"), F.round(share * F.abs(F.col("p") - F.col("o")), 6).alias("ece_part"), "brier")


@query(102, 343, sql=f"""WITH {BARS}, r AS (SELECT symbol, ts, ln(close / lag(close) OVER (PARTITION BY symbol ORDER BY ts)) AS r FROM bars),
c AS (SELECT a.symbol AS a, b.symbol AS b, coalesce(corr(a.r, b.r), 0) AS rho FROM r a JOIN r b ON a.ts = b.ts AND a.symbol < b.symbol GROUP BY 1, 2)
SELECT a, b, round(rho, 6) AS rho, round(1 / (1 + sum(CASE WHEN abs(rho) >= 0.02 THEN abs(rho) ELSE 0 END) OVER (PARTITION BY a)), 6) AS penalty FROM c""")
def correlation_matrix(spark, sf_dir):
    from ..functions import rolling as R

    r = T.bars_1h(spark, sf_dir).select("symbol", "ts", R.log_return(F.col("close"), R.series("symbol")).alias("r"))
    other = r.select(F.col("symbol").alias("b"), "ts", F.col("r").alias("rb"))
    c = r.withColumnRenamed("symbol", "a").join(other, "ts").filter("a < b").groupBy("a", "b").agg(F.coalesce(F.corr("r", "rb"), F.lit(0.0)).alias("rho"))
    big = F.sum(F.when(F.abs("rho") >= 0.02, F.abs("rho")).otherwise(0.0)).over(Window.partitionBy("a"))
    return c.select("a", "b", F.round("rho", 6).alias("rho"), F.round(1 / (1 + big), 6).alias("penalty"))


@query(114, 115, 118, 119, sql=f"""WITH {BARS}, g AS (SELECT *, date_diff('hour', lag(ts) OVER o, ts) AS gap, abs(close / lag(close) OVER o - 1) AS jump FROM bars WINDOW o AS (PARTITION BY symbol ORDER BY ts)),
m AS (SELECT symbol, gap AS modal FROM (SELECT symbol, gap, row_number() OVER (PARTITION BY symbol ORDER BY count(*) DESC, gap) AS k FROM g WHERE gap IS NOT NULL GROUP BY symbol, gap) WHERE k = 1)
SELECT symbol, count(*) AS bars, count(*) FILTER (high < greatest(open, close) OR low > least(open, close)) AS invalid, count(*) FILTER (least(open, high, low, close) <= 0) AS non_positive,
  count(*) FILTER (jump > 0.05) AS jumps, count(*) FILTER ((isodow(ts) = 6 AND hour(ts) >= 5) OR isodow(ts) = 7 OR (isodow(ts) = 1 AND hour(ts) < 5)) AS closed_window, any_value(modal) AS modal_gap,
  count(*) FILTER (gap > modal) AS gaps, CASE WHEN count(*) FILTER (gap > modal) > 0 THEN 'GAPS' ELSE 'CLEAN' END AS verdict FROM g JOIN m USING (symbol) GROUP BY symbol""")
def quality_audit(spark, sf_dir):
    from ..functions import rolling as R

    w = R.series("symbol")
    before = F.lag("ts").over(w)
    gap = F.timestamp_diff("hour", before, F.col("ts")) if hasattr(F, "timestamp_diff") else F.expr("timestampdiff(HOUR, lag(ts) over (partition by symbol order by ts), ts)")
    g = T.bars_1h(spark, sf_dir).withColumn("gap", gap).withColumn("jump", F.abs(F.col("close") / F.lag("close").over(w) - 1))
    modal = g.groupBy("symbol").agg(F.mode("gap", True).alias("modal"))
    d, h = F.weekday("ts"), F.hour("ts")
    closed = ((d == 5) & (h >= 5)) | (d == 6) | ((d == 0) & (h < 5))
    gaps = F.count_if(F.col("gap") > F.col("modal"))
    return g.join(modal, "symbol").groupBy("symbol").agg(
        F.count("*").alias("bars"), F.count_if((F.col("high") < F.greatest("open", "close")) | (F.col("low") > F.least("open", "close"))).alias("invalid"),
        F.count_if(F.least("open", "high", "low", "close") <= 0).alias("non_positive"), F.count_if(F.col("jump") > 0.05).alias("jumps"), F.count_if(closed).alias("closed_window"),
        F.first("modal").alias("modal_gap"), gaps.alias("gaps"), F.when(gaps > 0, "GAPS").otherwise("CLEAN").alias("verdict"),
    )
