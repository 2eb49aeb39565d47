"""Queries that attack results: delays, neighbours, cost ladders, resamples, and checks for looking ahead.

Resamples draw by hash of (iteration, place), so any engine repeats them and no
task holds a random state.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rolling as R
from ..operators import stats as S
from ..sources import tables as T
from .base import BARS, TRADES
from .discovery import _RET, returns
from .registry import query

COST = 0.00085


def _grid(columns: dict[str, tuple], rows: DataFrame) -> DataFrame:
    """rows, each once for every combination of the values."""
    for name, values in columns.items():
        rows = rows.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return rows


def _ahead(rows: DataFrame, most: int) -> DataFrame:
    """rows with later: the closes of the next `most` bars of the series, this one first."""
    w = R.series("symbol").rowsBetween(0, most)
    return rows.withColumn("later", F.collect_list("close").over(w))


def _fade(delay: Column, hold: Column) -> Column:
    """Return of fading the last bar, entered `delay` bars late and held for `hold`; null past the end."""
    at = lambda i: F.get("later", i)
    return -F.signum("r") * (F.try_divide(at(delay + hold), at(delay)) - 1)


_ATTACKS = [("base", 0, 4, 1.0), ("delay_1", 1, 4, 1.0), ("delay_2", 2, 4, 1.0), ("hold_2", 0, 2, 1.0), ("hold_3", 0, 3, 1.0), ("hold_5", 0, 5, 1.0), ("hold_6", 0, 6, 1.0), ("cost_1.5", 0, 4, 1.5), ("cost_2", 0, 4, 2.0), ("cost_3", 0, 4, 3.0)]
_ATTACK_SQL = ", ".join(f"('{a}', {d}, {h}, {m})" for a, d, h, m in _ATTACKS)


@query(319, 322, 323, 326, sql=f"""WITH {_RET}, a(attack, delay, hold, mult) AS (VALUES {_ATTACK_SQL}),
l AS (SELECT symbol, r, list(close) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN CURRENT ROW AND 8 FOLLOWING) AS later FROM r),
n AS (SELECT symbol, attack, -sign(r) * (later[1 + delay + hold] / later[1 + delay] - 1) - mult * {COST} AS net FROM l CROSS JOIN a WHERE r IS NOT NULL AND len(later) > delay + hold),
g AS (SELECT symbol, attack, count(*) AS n, avg(net) AS mean, avg(net) / (nullif(stddev_samp(net), 0) / sqrt(count(*))) AS t FROM n GROUP BY 1, 2)
SELECT symbol, attack, n, round(mean, 6) AS mean, round(t, 3) AS t, mean > 0 AS positive, round((sum(mean * n) OVER (PARTITION BY attack) - mean * n) / (sum(n) OVER (PARTITION BY attack) - n), 6) AS elsewhere FROM g""")
def adversarial_suite(spark, sf_dir):
    """Delays, neighbouring holds and cost shocks as a table of attacks, crossed with the trades in one pass; elsewhere is the mean of
    the other symbols."""
    r = _ahead(returns(spark, sf_dir), 8).filter("r is not null")
    attacks = F.array(*[F.struct(F.lit(a).alias("attack"), F.lit(d).alias("delay"), F.lit(h).alias("hold"), F.lit(m).alias("mult")) for a, d, h, m in _ATTACKS])
    n = r.withColumn("x", F.explode(attacks)).select("symbol", "r", "later", "x.*")
    n = n.select("symbol", "attack", (_fade(F.col("delay"), F.col("hold")) - F.col("mult") * COST).alias("net")).dropna()
    g = n.groupBy("symbol", "attack").agg(F.count("*").alias("n"), F.avg("net").alias("mean"), S.t_stat(F.col("net")).alias("t"))
    w = Window.partitionBy("attack")
    rest = F.try_divide(F.sum(F.col("mean") * F.col("n")).over(w) - F.col("mean") * F.col("n"), F.sum("n").over(w) - F.col("n"))
    return g.select("symbol", "attack", "n", F.round("mean", 6).alias("mean"), F.round("t", 3).alias("t"), (F.col("mean") > 0).alias("positive"), F.round(rest, 6).alias("elsewhere"))


_LOOK, _HOLD, _LEVEL, _MULT, _DELAY = (1, 2, 4, 8, 12), (2, 4, 8), (0.0, 0.1, 0.3, 0.6), (1.0, 1.5, 2.0), (0, 1)
_list = lambda v: "[" + ", ".join(map(str, v)) + "]"


@query(317, 318, sql=f"""WITH {_RET}, l AS (SELECT symbol, close, list(close) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN CURRENT ROW AND 10 FOLLOWING) AS later, list(close) OVER (PARTITION BY symbol ORDER BY ts DESC ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING) AS before FROM r),
f AS (SELECT symbol, look, delay, hold, close / before[1 + look] - 1 AS mom, later[1 + delay + hold] / later[1 + delay] - 1 AS fwd FROM l CROSS JOIN (SELECT unnest({_list(_LOOK)}) AS look)
  CROSS JOIN (SELECT unnest({_list(_DELAY)}) AS delay) CROSS JOIN (SELECT unnest({_list(_HOLD)}) AS hold) WHERE len(before) > look AND len(later) > delay + hold),
p AS (SELECT symbol, look, delay, hold, level, mult, avg(sign(mom) * fwd - mult * {COST}) AS mean, count(*) AS n FROM f CROSS JOIN (SELECT unnest({_list(_LEVEL)}) AS level) v CROSS JOIN (SELECT unnest({_list(_MULT)}) AS mult) c WHERE abs(mom) > level GROUP BY ALL)
SELECT symbol, count(*) AS points, round(avg((mean > 0)::INT), 6) AS profitable, round(min(mean), 6) AS worst, round(max(mean), 6) AS best, round(avg(mean), 6) AS mean, round(coalesce(stddev_samp(mean), 0), 6) AS spread,
  sum(n)::BIGINT AS trades FROM p GROUP BY symbol""")
def robustness_surface(spark, sf_dir):
    """A momentum rule on 360 points of look-back, hold, level, cost and delay. Look-backs and exits are sums per (symbol, point);
    costs only shift a mean, so they are added after the aggregation."""
    w = R.series("symbol")
    r = _ahead(returns(spark, sf_dir).select("symbol", "ts", "close"), 10)
    r = r.withColumns({f"x{k}": F.try_divide(F.col("close"), F.lag("close", k).over(w)) - 1 for k in _LOOK})
    moms = F.array(*[F.struct(F.lit(k).alias("look"), F.col(f"x{k}").alias("mom")) for k in _LOOK])
    r = r.withColumn("m", F.explode(moms)).select("symbol", "later", "m.*").filter("mom is not null")
    r = _grid({"delay": _DELAY, "hold": _HOLD}, r)
    fwd = F.try_divide(F.get("later", F.col("delay") + F.col("hold")), F.get("later", F.col("delay"))) - 1
    r = _grid({"level": _LEVEL}, r.select("symbol", "look", "delay", "hold", F.abs("mom").alias("size"), (F.signum("mom") * fwd).alias("gross")).dropna()).filter("size > level")
    p = r.groupBy("symbol", "look", "delay", "hold", "level").agg(F.avg("gross").alias("gross"), F.count("*").alias("n"))
    p = _grid({"mult": _MULT}, p).withColumn("mean", F.col("gross") - F.col("mult") * COST)
    return p.groupBy("symbol").agg(
        F.count("*").alias("points"), F.round(F.avg((F.col("mean") > 0).cast("int")), 6).alias("profitable"), F.round(F.min("mean"), 6).alias("worst"), F.round(F.max("mean"), 6).alias("best"),
        F.round(F.avg("mean"), 6).alias("mean"), F.round(F.coalesce(F.stddev_samp("mean"), F.lit(0.0)), 6).alias("spread"), F.sum("n").alias("trades"),
    )


_SCENARIOS = [("base", 1.0, 1.0), ("spread_x1.5", 1.5, 1.0), ("spread_x2", 2.0, 1.0), ("spread_x3", 3.0, 1.0), ("slip_x2", 1.0, 2.0), ("slip_x3", 1.0, 3.0), ("both_x2", 2.0, 2.0), ("both_x3", 3.0, 3.0)]


@query(320, sql=f"""WITH {TRADES}, s(scenario, a, b) AS (VALUES {", ".join(f"('{n}', {a}, {b})" for n, a, b in _SCENARIOS)}),
x AS (SELECT strategy, scenario, pnl - a * cost - b * 0.0001 * notional AS net FROM trades CROSS JOIN s), g AS (SELECT strategy, scenario, round(sum(net), 2) AS net, round(avg((net > 0)::INT), 6) AS win_rate FROM x GROUP BY 1, 2)
SELECT *, net > 0 AS survives, round(net - max(CASE WHEN scenario = 'base' THEN net END) OVER (PARTITION BY strategy), 2) AS change FROM g""")
def cost_stress_ladder(spark, sf_dir):
    """Eight scenarios of spread and slippage multipliers over all trades."""
    scenarios = F.array(*[F.struct(F.lit(n).alias("scenario"), F.lit(a).alias("a"), F.lit(b).alias("b")) for n, a, b in _SCENARIOS])
    t = T.trades(spark, sf_dir).withColumn("s", F.explode(scenarios))
    net = F.col("pnl") - F.col("s.a") * F.col("cost") - F.col("s.b") * 0.0001 * F.col("notional")
    g = t.groupBy("strategy", F.col("s.scenario").alias("scenario")).agg(F.round(F.sum(net), 2).alias("net"), F.round(S.win_rate(net), 6).alias("win_rate"))
    base = F.max(F.when(F.col("scenario") == "base", F.col("net"))).over(Window.partitionBy("strategy"))
    return g.select("*", (F.col("net") > 0).alias("survives"), F.round(F.col("net") - base, 2).alias("change"))


ITERATIONS, BLOCK = 200, 20


def drawn(seed: str, *parts: Column) -> Column:
    """A number in [0, 2**60) by hash of the parts."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), *[p.cast("string") for p in parts]).cast("binary")), 1, 15), 16, 10).cast("long")


_DRAWN = "('0x' || md5('{0}:' || {1})[1:15])::BIGINT"
_DAILY = f"""{TRADES}, d AS (SELECT strategy, exit_ts, round(sum(pnl), 4) AS x FROM trades GROUP BY 1, 2), v AS (SELECT strategy, x, row_number() OVER (PARTITION BY strategy ORDER BY exit_ts) - 1 AS i, count(*) OVER (PARTITION BY strategy) AS n FROM d),
it AS (SELECT unnest(range(0, {ITERATIONS})) AS it)"""


def daily_results(spark, sf_dir) -> DataFrame:
    """(strategy, x, i, n): results of trading days, numbered; days are few however many trades there are."""
    d = T.trades(spark, sf_dir).groupBy("strategy", "exit_ts").agg(F.round(F.sum("pnl"), 4).alias("x"))
    w = Window.partitionBy("strategy")
    return d.select("strategy", "x", (F.row_number().over(w.orderBy("exit_ts")) - 1).alias("i"), F.count("*").over(w).alias("n"))


def _iterations(v: DataFrame) -> DataFrame:
    return v.withColumn("it", F.explode(F.sequence(F.lit(0), F.lit(ITERATIONS - 1))))


def _resampled(slots: DataFrame, v: DataFrame) -> DataFrame:
    """slots (strategy, it, i) with the values of their places."""
    return slots.join(v.select("strategy", "i", "x"), ["strategy", "i"])


@query(328, 325, sql=f"""WITH {_DAILY}, s AS (SELECT v.strategy, it, {_DRAWN.format("iid", "strategy || ':' || it || ':' || i")} % n AS i FROM v CROSS JOIN it),
m AS (SELECT s.strategy, it, avg(x) AS mean FROM s JOIN v ON v.strategy = s.strategy AND v.i = s.i GROUP BY 1, 2)
SELECT strategy, count(*) AS resamples, round(quantile_cont(mean, 0.025), 4) AS low, round(quantile_cont(mean, 0.975), 4) AS high, round(avg((mean > 0)::INT), 6) AS positive, avg((mean > 0)::INT) >= 0.95 AS survives FROM m GROUP BY strategy""")
def iid_bootstrap(spark, sf_dir):
    """Means of resampled days, drawn with replacement."""
    v = daily_results(spark, sf_dir)
    slots = _iterations(v).select("strategy", "it", F.pmod(drawn("iid", F.col("strategy"), F.col("it"), F.col("i")), "n").alias("i"))
    m = _resampled(slots, v).groupBy("strategy", "it").agg(F.avg("x").alias("mean"))
    share = F.avg((F.col("mean") > 0).cast("int"))
    return m.groupBy("strategy").agg(F.count("*").alias("resamples"), F.round(F.percentile("mean", 0.025), 4).alias("low"), F.round(F.percentile("mean", 0.975), 4).alias("high"), F.round(share, 6).alias("positive"), (share >= 0.95).alias("survives"))


@query(329, 330, sql=f"""WITH {_DAILY}, s AS (SELECT v.strategy, it, i AS slot, ({_DRAWN.format("block", f"strategy || ':' || it || ':' || (i // {BLOCK})")} % (n - least({BLOCK}, n) + 1)) + i % {BLOCK} AS i FROM v CROSS JOIN it),
x AS (SELECT s.strategy, it, slot, x FROM s JOIN v ON v.strategy = s.strategy AND v.i = s.i), e AS (SELECT *, sum(x) OVER (PARTITION BY strategy, it ORDER BY slot) AS equity FROM x),
p AS (SELECT *, greatest(max(equity) OVER (PARTITION BY strategy, it ORDER BY slot), 0) AS peak FROM e),
m AS (SELECT strategy, it, avg(x) AS mean, max(peak - equity) AS dd, avg(x) / nullif(stddev_samp(x), 0) AS ratio FROM p GROUP BY 1, 2)
SELECT strategy, round(quantile_cont(mean, 0.025), 4) AS low, round(quantile_cont(mean, 0.975), 4) AS high, round(quantile_cont(dd, 0.5), 2) AS dd_mid, round(quantile_cont(dd, 0.95), 2) AS dd_95, round(stddev_samp(ratio), 6) AS ratio_se,
  round(avg((mean <= 0)::INT), 6) AS p_loss, round(avg((dd >= 1000000)::INT), 6) AS ruin FROM m GROUP BY strategy""")
def block_bootstrap(spark, sf_dir):
    """Moving blocks keep the dependence of neighbouring days; intervals of the mean and ratio, and the drawdowns of resampled series."""
    v = daily_results(spark, sf_dir)
    size = F.least(F.lit(BLOCK), F.col("n"))
    start = F.pmod(drawn("block", F.col("strategy"), F.col("it"), F.floor(F.col("i") / BLOCK)), F.col("n") - size + 1)
    slots = _iterations(v).select("strategy", "it", F.col("i").alias("slot"), (start + F.col("i") % BLOCK).alias("i"))
    w = Window.partitionBy("strategy", "it").orderBy("slot").rowsBetween(Window.unboundedPreceding, 0)
    x = _resampled(slots, v).withColumn("equity", F.sum("x").over(w))
    x = x.withColumn("down", F.greatest(F.max("equity").over(w), F.lit(0.0)) - F.col("equity"))
    m = x.groupBy("strategy", "it").agg(F.avg("x").alias("mean"), F.max("down").alias("dd"), F.try_divide(F.avg("x"), F.nullif(F.stddev_samp("x"), F.lit(0.0))).alias("ratio"))
    q = lambda c, p, d: F.round(F.percentile(c, p), d)
    return m.groupBy("strategy").agg(
        q("mean", 0.025, 4).alias("low"), q("mean", 0.975, 4).alias("high"), q("dd", 0.5, 2).alias("dd_mid"), q("dd", 0.95, 2).alias("dd_95"), F.round(F.stddev_samp("ratio"), 6).alias("ratio_se"),
        F.round(F.avg((F.col("mean") <= 0).cast("int")), 6).alias("p_loss"), F.round(F.avg((F.col("dd") >= 1_000_000).cast("int")), 6).alias("ruin"),
    )


@query(113, sql=f"""WITH {_RET}, v AS (SELECT symbol, r, close / lag(close) OVER o - 1 AS pc, k FROM r WINDOW o AS (PARTITION BY symbol ORDER BY ts)), s AS (SELECT *, CASE WHEN count(pc) OVER w >= 20 THEN stddev_samp(pc) OVER w END AS vol FROM v WINDOW w AS (PARTITION BY symbol ORDER BY k ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)),
q AS (SELECT symbol, quantile_cont(vol, 1.0 / 3) AS a, quantile_cont(vol, 2.0 / 3) AS b FROM s GROUP BY symbol)
SELECT s.symbol, CASE WHEN vol <= a THEN 'low_volatility' WHEN vol <= b THEN 'mid_volatility' ELSE 'high_volatility' END AS regime, count(*) AS n,
  round(CASE WHEN count(r) >= 2 AND stddev_samp(r) > 1e-12 THEN avg(r) / stddev_samp(r) * sqrt(252 * 24) ELSE 0 END, 4) AS sharpe FROM s JOIN q USING (symbol) WHERE vol IS NOT NULL GROUP BY 1, 2""")
def regime_sharpe(spark, sf_dir):
    """Terciles of the rolling deviation of returns, and the ratio of the returns inside each."""
    w = R.series("symbol")
    v = returns(spark, sf_dir).withColumn("pc", F.try_divide(F.col("close"), F.lag("close").over(w)) - 1)
    frame = w.rowsBetween(-49, 0)
    v = v.select("symbol", "r", F.when(F.count("pc").over(frame) >= 20, F.stddev_samp("pc").over(frame)).alias("vol")).filter("vol is not null")
    q = F.broadcast(v.groupBy("symbol").agg(F.percentile("vol", F.array(F.lit(1 / 3), F.lit(2 / 3))).alias("q")))  # a row per symbol
    regime = F.when(F.col("vol") <= F.get("q", F.lit(0)), "low_volatility").when(F.col("vol") <= F.get("q", F.lit(1)), "mid_volatility").otherwise("high_volatility")
    return v.join(q, "symbol").groupBy("symbol", regime.alias("regime")).agg(F.count("*").alias("n"), F.round(S.sharpe(F.col("r"), 252.0 * 24), 4).alias("sharpe"))


def _features(bars: DataFrame, leaky: bool) -> DataFrame:
    w = R.series("symbol")
    c = F.col("close")
    columns = {"sma": R.sma(c, 20, w), "z": R.zscore(c, 20, w), "ret": R.log_return(c, w), "top": R.donchian(F.col("high"), F.col("low"), 20, w, upto=-1)[0]}
    if leaky:
        columns["ahead"] = F.lead("close").over(w)
    return bars.select("symbol", "ts", F.xxhash64(*[F.coalesce(F.round(x, 9), F.lit(-1.0)) for x in columns.values()]).alias("f"))


CUT = "2024-01-15 00:00:00"


@query(334, 335, 336, sql=f"""WITH {BARS}, c AS (SELECT symbol, count(*) AS rows, max(ts) AS last FROM bars WHERE ts < TIMESTAMP '{CUT}' GROUP BY symbol), m AS (SELECT symbol, max(ts) AS until FROM bars GROUP BY symbol)
SELECT symbol, test, rows, CASE WHEN test LIKE 'causal%' OR until = last THEN 0 ELSE 1 END AS changed FROM c JOIN m USING (symbol) CROSS JOIN (SELECT unnest(['causal_truncated', 'causal_shocked', 'causal_next_bar', 'leaky_truncated', 'leaky_shocked', 'leaky_next_bar']) AS test)""")
def leakage_audit(spark, sf_dir):
    """Features of the bars before a cut, from all bars, from those alone, with all later bars shocked, and with only the next one: causal
    features never change, one that looks a bar ahead does in the last row."""
    bars = T.bars_1h(spark, sf_dir).select("symbol", "ts", "high", "low", "close")
    cut = F.lit(CUT).cast("timestamp_ntz")
    place = F.row_number().over(Window.partitionBy("symbol", F.col("ts") < cut).orderBy("ts"))
    bars = bars.withColumn("_k", F.when(F.col("ts") >= cut, place))
    shock = lambda d, when: d.withColumns({c: F.when(when, F.col(c) * 3 + 1).otherwise(F.col(c)) for c in ("high", "low", "close")})
    later = F.col("_k").isNotNull()
    versions = {"truncated": bars.filter(~later), "shocked": shock(bars, later), "next_bar": shock(bars, F.coalesce(F.col("_k") == 1, F.lit(False)))}
    out = None
    for kind, leaky in (("causal", False), ("leaky", True)):
        full = _features(bars, leaky).filter(F.col("ts") < cut)
        for name, version in versions.items():
            other = _features(version, leaky).withColumnRenamed("f", "g")
            got = full.join(other, ["symbol", "ts"]).groupBy("symbol").agg(F.count("*").alias("rows"), F.count_if(F.col("f") != F.col("g")).alias("changed"))
            got = got.select("symbol", F.lit(f"{kind}_{name}").alias("test"), "rows", "changed")
            out = got if out is None else out.unionByName(got)
    return out
