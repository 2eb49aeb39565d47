"""Decisions that depend on earlier ones, votes of rules, and gates; sequential passes in SQL are their oracles."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as X
from ..operators import decisions as D
from ..operators import stats as S
from ..operators import strategies as G
from ..sources import tables as T
from .base import BARS, TRADES
from .registry import query
from .scalars_sql import ppf_sql, two_sided_p_sql
from .strategies import _INDICATORS
from .walkforward import _FOLDS, momentum_returns

_TOKENS = "[split_part(p_name, ' ', 1), split_part(p_name, ' ', 2), p_brand, p_type]"


@query(203, sql=f"""WITH RECURSIVE i AS (SELECT id, row_number() OVER (ORDER BY price DESC, id) AS k, [t[1] || '|' || t[2] || '|' || t[3], t[1] || '|' || t[2] || '||' || t[4], t[1] || '||' || t[3] || '|' || t[4], '|' || t[2] || '|' || t[3] || '|' || t[4]] AS keys
  FROM (SELECT p_partkey AS id, p_retailprice AS price, {_TOKENS} AS t FROM part)),
s AS (SELECT 0::BIGINT AS k, NULL::BIGINT AS id, false AS kept, []::VARCHAR[] AS seen
  UNION ALL SELECT i.k, i.id, NOT list_has_any(i.keys, s.seen), CASE WHEN list_has_any(i.keys, s.seen) THEN s.seen ELSE list_concat(s.seen, i.keys) END FROM s JOIN i ON i.k = s.k + 1)
SELECT id, k AS rank, kept FROM s WHERE k > 0""")
def greedy_novelty(spark, sf_dir):
    """Parts in falling price, each kept unless a kept one before it shares three of its four attributes (Jaccard 0.6)."""
    t = [F.split("p_name", " ")[0], F.split("p_name", " ")[1], F.col("p_brand"), F.col("p_type")]
    keys = [F.concat_ws("|", *[F.lit("") if i == j else t[i] for i in range(4)]) for j in range(4)]
    p = T.table(spark, sf_dir, "part").withColumn("keys", F.array(*keys))
    order = p.select("p_retailprice", "p_partkey")  # a rank from counts of what is dearer, without one window over all parts
    dearer = order.groupBy("p_retailprice").count()
    above = dearer.withColumn("above", F.sum("count").over(Window.orderBy(F.desc("p_retailprice")).rowsBetween(Window.unboundedPreceding, -1)))  # a row a price
    within = F.row_number().over(Window.partitionBy("p_retailprice").orderBy("p_partkey"))
    ranked = p.join(above.select("p_retailprice", F.coalesce("above", F.lit(0)).alias("above")), "p_retailprice").withColumn("rank", F.col("above") + within)
    return D.greedy_novel(ranked, "rank", "keys").select(F.col("p_partkey").alias("id"), "rank", "kept")


@query(54, sql="""WITH RECURSIVE d AS (SELECT o_orderkey AS id, o_orderdate AS day, floor(o_totalprice / 100)::BIGINT AS amount, o_orderstatus <> 'P' AS asks, row_number() OVER (PARTITION BY o_orderdate ORDER BY o_orderkey) AS k FROM orders),
s AS (SELECT DISTINCT day, 0::BIGINT AS k, NULL::BIGINT AS id, 0::BIGINT AS total, 0::BIGINT AS n, NULL::VARCHAR AS reason FROM d
  UNION ALL SELECT day, k, id, total + CASE WHEN asks AND reason IS NULL THEN amount ELSE 0 END, n + (asks AND reason IS NULL)::INT, reason FROM (
    SELECT d.day, d.k, d.id, d.amount, d.asks, s.total, s.n, CASE WHEN NOT asks THEN NULL WHEN s.total + d.amount > 8000 THEN 'TOTAL_ALLOCATION' WHEN d.amount > 4000 THEN 'PER_STRATEGY' WHEN s.n >= 5 THEN 'POSITIONS' WHEN s.n >= 3 THEN 'CORRELATION' END AS reason
    FROM s JOIN d ON d.day = s.day AND d.k = s.k + 1))
SELECT id, day, reason FROM s WHERE k > 0""")
def portfolio_authorisation(spark, sf_dir):
    """A day's orders in turn against the day's budgets (in hundreds); pending ones do not ask."""
    o = T.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("day"), F.floor(F.col("o_totalprice") / 100).alias("amount"), "o_orderstatus")
    return D.authorise(o, "day", "id", "amount", F.col("o_orderstatus") != "P", D.Limits(8000, 4000)).select("id", "day", "reason")


@query(350, sql="""WITH RECURSIVE e AS (SELECT user_id, (ts::DATE - DATE '2024-01-01')::INT AS day, count(*) AS trades, coalesce(round(avg(value) / nullif(stddev_samp(value), 0) - 0.6, 6), 0) AS sharpe, count(*) FILTER (event_type = 'error') / count(*) AS dd FROM events GROUP BY 1, 2),
o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY day) AS k FROM e),
s AS (SELECT user_id, 0::BIGINT AS k, 'ACTIVE' AS phase, day AS since, 0::BIGINT AS good, 0::BIGINT AS bad, 0::BIGINT AS moves FROM o WHERE k = 1
  UNION ALL SELECT user_id, k, CASE WHEN move THEN target ELSE phase END, CASE WHEN move THEN day ELSE since END, CASE WHEN move THEN 0 ELSE good END, CASE WHEN move THEN 0 ELSE bad END, moves + move::INT FROM (
    SELECT *, judged AND target <> phase AND day - since >= 1 AS move FROM (
      SELECT *, CASE WHEN phase IN ('ACTIVE', 'DEGRADED') AND (sharpe < 0 OR dd >= 0.5) THEN 'PAUSED' WHEN phase = 'ACTIVE' AND sharpe < 0.5 THEN 'DEGRADED' WHEN phase = 'DEGRADED' AND sharpe >= 0.75 AND good >= 2 THEN 'ACTIVE'
        WHEN phase = 'PAUSED' AND sharpe >= 0.75 AND good >= 2 THEN 'DEGRADED' WHEN phase = 'PAUSED' AND day - since >= 6 THEN 'RETIRED' ELSE phase END AS target FROM (
        SELECT *, CASE WHEN judged AND sharpe >= 0.75 THEN good0 + 1 WHEN judged AND sharpe < 0.5 THEN 0 ELSE good0 END AS good, CASE WHEN judged AND sharpe >= 0.75 THEN 0 WHEN judged AND sharpe < 0.5 THEN bad0 + 1 ELSE bad0 END AS bad FROM (
          SELECT o.user_id, o.k, o.day, o.sharpe, o.dd, s.phase, s.since, s.moves, s.good AS good0, s.bad AS bad0, s.phase <> 'RETIRED' AND NOT (s.phase = 'ACTIVE' AND o.trades < 2) AS judged FROM s JOIN o ON o.user_id = s.user_id AND o.k = s.k + 1)))))
SELECT s.user_id, phase, since, good AS good_runs, bad AS bad_runs, moves, evaluations, best_sharpe FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY k DESC) AS last FROM s) s
JOIN (SELECT user_id, count(*) AS evaluations, max(sharpe) AS best_sharpe FROM e GROUP BY 1) USING (user_id) WHERE last = 1""")
def lifecycle_states(spark, sf_dir):
    """A day of a user is an evaluation: its mean over its deviation, its events, and the share of errors as drawdown."""
    e = T.table(spark, sf_dir, "events")
    day = F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date"))
    v = F.col("value")
    ratio = F.coalesce(F.round(F.avg(v) / F.nullif(F.stddev_samp(v), F.lit(0.0)) - 0.6, 6), F.lit(0.0))
    e = e.groupBy("user_id", day.alias("day")).agg(F.count("*").alias("trades"), ratio.alias("sharpe"), (F.count_if(F.col("event_type") == "error") / F.count("*")).alias("dd"), F.lit(0).alias("seq"))
    return D.lifecycle(e, "user_id", "day", D.Policy(trades=2, retire=6), length=16)


# The net share of weight for a clear majority, the least weight, and votes of an ensemble.
MAJORITY, LEAST_WEIGHT, MIN_VOTES = 0.34, 0.01, 2.0
#: Members of the votes and how far each is trusted.
MEMBERS = {"macd": 0.9, "adx": 0.8, "supertrend": 0.7, "rsi": 0.6}
_CONFIDENCE = "(0.35 + 0.6 * coalesce(least(greatest((abs(close - ema_20) / nullif(2 * atr_20, 0) - 0.5) / 2, 0), 1), 0.5))"
_WEIGHT = {m: f"CASE WHEN {m} <> 0 THEN greatest({_CONFIDENCE} * {t}, {LEAST_WEIGHT}) ELSE 0 END" for m, t in MEMBERS.items()}
_STOPS = ", ".join(f"CASE WHEN {m} <> 0 THEN {'st_line' if m == 'supertrend' else f'close - 2 * {m} * atr'} END" for m in MEMBERS)
_TARGETS = ", ".join(f"CASE WHEN {m} <> 0 THEN close + 3 * {m} * atr END" for m in MEMBERS)


@query(348, 349, sql=f"""{_INDICATORS}, v AS (SELECT *, {" + ".join(f"{m} * ({w})" for m, w in _WEIGHT.items())} AS votes, {" + ".join(f"({w})" for w in _WEIGHT.values())} AS weight,
  {" + ".join(f"{m} * {_CONFIDENCE} * {t}" for m, t in MEMBERS.items())} AS ensemble FROM signals),
d AS (SELECT *, CASE WHEN abs(round(votes / nullif(weight, 0), 9)) >= {MAJORITY} THEN sign(votes)::INT ELSE 0 END AS direction FROM v)
SELECT symbol, ts, direction, round(CASE WHEN direction <> 0 THEN least(abs(votes) / {len(MEMBERS)}, 1) ELSE 0 END, 6) AS confidence, round(coalesce(abs(votes) / nullif(weight, 0), 0), 6) AS agreement,
  round(CASE direction WHEN 1 THEN greatest({_STOPS}) WHEN -1 THEN least({_STOPS}) END, 6) AS stop_loss, round(CASE direction WHEN 1 THEN least({_TARGETS}) WHEN -1 THEN greatest({_TARGETS}) END, 6) AS take_profit,
  CASE WHEN round(ensemble, 9) >= {MIN_VOTES / 2} THEN 1 WHEN round(ensemble, 9) <= -{MIN_VOTES / 2} THEN -1 ELSE 0 END AS ensemble FROM d""")
def signal_vote(spark, sf_dir):
    """The confidence-weighted vote of four rules with the tightest stop and the nearest target of those that take a side, and the ensemble
    that compares the sum of weighted signals with half the votes it wants."""
    s = G.recurrent_signals(T.bars_1h(spark, sf_dir))
    sure = G.scaled_confidence(F.col("excursion"), 0.5, 2.5)
    member = lambda m, trust: F.struct(F.col(m).alias("side"), (sure * trust).alias("sure"), (F.col("line") if m == "supertrend" else F.col("close") - G.SL_ATR * F.col(m) * F.col("atr")).alias("stop"), (F.col("close") + G.TP_ATR * F.col(m) * F.col("atr")).alias("target"))
    s = s.select("symbol", "ts", F.array(*[member(m, t) for m, t in MEMBERS.items()]).alias("each"))
    taken = F.filter("each", lambda x: x["side"] != 0)
    add = lambda value: F.aggregate(taken, F.lit(0.0), lambda a, x: a + value(x))
    heavy = lambda x: F.greatest(x["sure"], F.lit(LEAST_WEIGHT))
    s = s.select("symbol", "ts", taken.alias("taken"), add(lambda x: x["side"] * heavy(x)).alias("votes"), add(heavy).alias("weight"), add(lambda x: x["side"] * x["sure"]).alias("sum"))
    net = F.try_divide("votes", F.nullif("weight", F.lit(0.0)))
    s = s.withColumn("direction", F.when(F.abs(F.round(net, 9)) >= MAJORITY, F.signum("votes").cast("int")).otherwise(0))
    of = lambda name: F.transform("taken", lambda x: x[name])
    tight = lambda up, down: F.round(F.when(F.col("direction") == 1, up).when(F.col("direction") == -1, down), 6)
    side = F.col("direction") != 0
    return s.select(
        "symbol", "ts", "direction", F.round(F.when(side, F.least(F.abs("votes") / len(MEMBERS), F.lit(1.0))).otherwise(0.0), 6).alias("confidence"), F.round(F.coalesce(F.abs(net), F.lit(0.0)), 6).alias("agreement"),
        tight(F.array_max(of("stop")), F.array_min(of("stop"))).alias("stop_loss"), tight(F.array_min(of("target")), F.array_max(of("target"))).alias("take_profit"),
        G.side(F.round("sum", 9) >= MIN_VOTES / 2, F.round("sum", 9) <= -MIN_VOTES / 2).alias("ensemble"),
    )


# Gates of the sealed holdout.
GATE_TRADES, GATE_T, GATE_FACTOR, FAMILY_ALPHA = 30, 2.0, 1.1, 0.05


@query(333, sql=f"""WITH {_FOLDS.split(", f AS (")[0]}, h AS (SELECT x.* FROM x JOIN (SELECT symbol, max(len) AS len FROM r GROUP BY symbol) USING (symbol) WHERE pos >= floor(0.8 * len)),
s AS (SELECT symbol, lookback, count(*) AS n, avg(x) AS mean, round(avg(x) / nullif(stddev_samp(x), 0) * sqrt(count(*)), 9) AS t, coalesce(sum(x) FILTER (x > 0), 0) / nullif(abs(coalesce(sum(x) FILTER (x < 0), 0)), 0) AS pf FROM h GROUP BY 1, 2),
g AS (SELECT *, {two_sided_p_sql("t")} AS p, {FAMILY_ALPHA} / count(*) OVER () AS alpha FROM s)
SELECT symbol, lookback, n, round(t, 6) AS t, round(p, 8) AS p, round(alpha, 8) AS alpha, CASE WHEN n < {GATE_TRADES} THEN 'MIN_TRADES' WHEN mean <= 0 THEN 'EXPECTANCY' WHEN coalesce(t, 0) < {GATE_T} THEN 'SIGNIFICANCE'
  WHEN coalesce(pf, 999) < {GATE_FACTOR} THEN 'PROFIT_FACTOR' WHEN coalesce(p, 1) >= alpha THEN 'MULTIPLE_TESTING' END AS failed FROM g""")
def holdout_gates(spark, sf_dir):
    """The last fifth of each series: five gates in turn, the last corrected for the number of configurations tried; null passed all."""
    bars = T.bars_1h(spark, sf_dir)
    x, n = F.col("x"), bars.groupBy("symbol").agg(F.count("*").alias("len"))
    h = momentum_returns(bars).join(F.broadcast(n), "symbol").filter(F.col("pos") >= F.floor(0.8 * F.col("len"))).filter(x.isNotNull())  # a row a symbol
    t = F.round(F.avg(x) / F.nullif(F.stddev_samp(x), F.lit(0.0)) * F.sqrt(F.count(x)), 9)
    s = h.groupBy("symbol", "lookback").agg(F.count(x).alias("n"), F.avg(x).alias("mean"), t.alias("t"), S.profit_factor(x).alias("pf"))
    tried = s.agg(F.count("*").alias("m"))
    s = s.join(F.broadcast(tried), F.lit(True)).withColumns({"p": X.two_sided_p(F.col("t")), "alpha": FAMILY_ALPHA / F.col("m")})  # one row
    failed = (
        F.when(F.col("n") < GATE_TRADES, "MIN_TRADES").when(F.col("mean") <= 0, "EXPECTANCY").when(F.coalesce("t", F.lit(0.0)) < GATE_T, "SIGNIFICANCE")
        .when(F.col("pf") < GATE_FACTOR, "PROFIT_FACTOR").when(F.coalesce("p", F.lit(1.0)) >= F.col("alpha"), "MULTIPLE_TESTING")
    )
    return s.select("symbol", "lookback", "n", F.round("t", 6).alias("t"), F.round("p", 8).alias("p"), F.round("alpha", 8).alias("alpha"), failed.alias("failed"))


@query(347, sql=f"""WITH {TRADES}, g AS (SELECT strategy, regime, avg(pnl) AS mean FROM trades GROUP BY 1, 2), q AS (SELECT strategy, count(*) AS trials, avg((mean <= 0)::INT) AS pbo FROM g GROUP BY 1),
s AS (SELECT strategy, avg(pnl) / stddev_samp(pnl) AS sharpe, coalesce(sum(pnl) FILTER (pnl > 0), 0) / nullif(abs(sum(pnl) FILTER (pnl < 0)), 0) AS pf, avg((pnl > 0)::INT) AS win, count(*) AS n FROM trades GROUP BY 1),
c AS (SELECT *, (least(sharpe / 2, 1) + least(coalesce(pf, 999) / 3, 1) + win + least(n / 500, 1) + least(sharpe / trials, 1)) / 5 * (1 - least(pbo, 1)) AS score FROM s JOIN q USING (strategy))
SELECT strategy, n, trials, round(pbo, 6) AS pbo, round(least(score, 1), 6) AS score, CASE WHEN score >= 0.7 AND n >= 100 AND trials >= 10 THEN 'HIGH' WHEN score >= 0.5 THEN 'MEDIUM' ELSE 'LOW' END AS tier FROM c""")
def evidence_score(spark, sf_dir):
    """The mean of five capped parts less the share of regimes that lose; regimes are the trials."""
    t = T.trades(spark, sf_dir)
    x, cap = F.col("pnl"), lambda v: F.least(v, F.lit(1.0))
    sums = t.groupBy("strategy", "regime").agg(F.count(x).alias("n"), F.sum(x).alias("s"), F.sum(x * x).alias("q"), F.sum(F.when(x > 0, x).otherwise(0.0)).alias("up"), F.sum(F.when(x < 0, x).otherwise(0.0)).alias("down"), F.count_if(x > 0).alias("wins"))
    g = sums.groupBy("strategy").agg(*[F.sum(c).alias(c) for c in ("n", "s", "q", "up", "down", "wins")], F.count("*").alias("trials"), F.avg((F.col("s") <= 0).cast("int")).alias("pbo"))
    n, s, q = F.col("n"), F.col("s"), F.col("q")
    sharpe = s / n / F.sqrt((q - s * s / n) / (n - 1))
    pf = F.coalesce(F.col("up") / F.nullif(F.abs("down"), F.lit(0.0)), F.lit(999.0))
    score = (cap(sharpe / 2) + cap(pf / 3) + F.col("wins") / n + cap(n / 500) + cap(sharpe / F.col("trials"))) / 5 * (1 - cap(F.col("pbo")))
    g = g.withColumn("score", score)
    tier = F.when((F.col("score") >= 0.7) & (n >= 100) & (F.col("trials") >= 10), "HIGH").when(F.col("score") >= 0.5, "MEDIUM").otherwise("LOW")
    return g.select("strategy", "n", "trials", F.round("pbo", 6).alias("pbo"), F.round(cap(F.col("score")), 6).alias("score"), tier.alias("tier"))


@query(276, sql=f"""WITH {BARS}, e AS (SELECT symbol, ts, close / first_value(close) OVER (PARTITION BY symbol ORDER BY ts) AS equity FROM bars), l AS (SELECT symbol, 1.0::DOUBLE / count(*) OVER () AS w FROM (SELECT DISTINCT symbol FROM e)),
t AS (SELECT DISTINCT ts FROM e) SELECT ts, count(equity) AS legs, round(sum(w * coalesce(equity, 1)) * 10000, 4) AS equity FROM t CROSS JOIN l LEFT JOIN e USING (symbol, ts) GROUP BY ts""")
def portfolio_blend(spark, sf_dir):
    """Equal legs of each symbol's curve; a leg that has no bar at a time counts with its flat weight, so only present legs are added up."""
    e = T.bars_1h(spark, sf_dir)
    start = e.groupBy("symbol").agg(F.min_by("close", "ts").alias("first"))
    legs = start.agg(F.count("*").alias("m"))
    start = start.join(F.broadcast(legs), F.lit(True))  # one row
    e = e.join(F.broadcast(start), "symbol").withColumns({"w": 1 / F.col("m"), "equity": F.col("close") / F.col("first")})  # a row a symbol
    return e.groupBy("ts").agg(F.count("*").alias("legs"), F.round((1 + F.sum(F.col("w") * (F.col("equity") - 1))) * 10000, 4).alias("equity"))


#: Paths of the simulation and the confidence of its loss.
PATHS, VAR_CONFIDENCE = 2000, 0.95


@query(341, sql=f"""WITH {BARS}, p AS (SELECT symbol, last(close ORDER BY ts) * count(*) AS notional, CASE WHEN last(close ORDER BY ts) >= first(close ORDER BY ts) THEN 1 ELSE -1 END AS side FROM bars GROUP BY symbol),
r AS (SELECT symbol, stddev_samp(x) / 10 AS dev FROM (SELECT symbol, ln(close / lag(close) OVER (PARTITION BY symbol ORDER BY ts)) AS x FROM bars) GROUP BY symbol),
u AS (SELECT i, symbol, (('0x' || substr(md5('1234:' || i || ':' || symbol), 1, 8))::BIGINT + 0.5) / 4294967296 AS u FROM (SELECT unnest(range({PATHS})) AS i), p),
z AS (SELECT i, sum(side * notional * dev * {ppf_sql("u")}) AS pnl FROM u JOIN p USING (symbol) JOIN r USING (symbol) GROUP BY i)
SELECT round(abs(least(quantile_cont(pnl, {1 - VAR_CONFIDENCE:.2f}), 0)) / (SELECT sum(notional) FROM p), 9) AS var, count(*) AS paths FROM z""")
def monte_carlo_var(spark, sf_dir):
    """Normal shocks whose uniform numbers are hashes of seed, path and symbol: the same on every run, partitioning and engine."""
    bars = T.bars_1h(spark, sf_dir)
    c, w = F.col("close"), Window.partitionBy("symbol").orderBy("ts")
    last, first = F.max_by(c, "ts"), F.min_by(c, "ts")
    r = bars.select("symbol", "ts", "close", F.ln(c / F.lag(c).over(w)).alias("x"))
    p = r.groupBy("symbol").agg((last * F.count("*")).alias("notional"), F.when(last >= first, 1).otherwise(-1).alias("side"), (F.stddev_samp("x") / 10).alias("dev"))
    paths = p.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(PATHS - 1))))
    u = (F.conv(F.substring(F.md5(F.concat_ws(":", F.lit("1234"), F.col("i"), "symbol").cast("binary")), 1, 8), 16, 10).cast("long") + 0.5) / 4294967296
    z = paths.groupBy("i").agg(F.sum(F.col("side") * F.col("notional") * F.col("dev") * X.normal_ppf(u)).alias("pnl"))
    whole = p.agg(F.sum("notional").alias("whole"))
    loss = z.agg(F.percentile("pnl", 1 - VAR_CONFIDENCE).alias("q"), F.count("*").alias("paths"))  # over the paths, whose number is stated
    return loss.join(F.broadcast(whole), F.lit(True)).select(F.round(F.abs(F.least("q", F.lit(0.0))) / F.col("whole"), 9).alias("var"), "paths")


#: Units of notional that a unit of margin carries, and the money an account begins with.
LEVERAGE, CAPITAL = 30, 1_000_000


@query(131, sql=f"""WITH {TRADES}, p AS (SELECT o_custkey AS account, sum(notional) / {LEVERAGE} AS margin, sum(pnl) AS profit, count(*) AS positions FROM trades JOIN orders ON o_orderkey = orderkey GROUP BY 1)
SELECT c_custkey AS account, coalesce(positions, 0) AS positions, round(coalesce(margin, 0), 3) AS margin, round(coalesce(profit, 0), 4) AS profit, round(c_acctbal * 100 + coalesce(profit, 0), 4) AS equity, round(c_acctbal * 100 + coalesce(profit, 0) - coalesce(margin, 0), 4) AS free_margin,
  CASE WHEN margin > 0 THEN round(100 * (c_acctbal * 100 + profit) / margin, 4) END AS level FROM customer LEFT JOIN p ON account = c_custkey""")
def account_snapshot(spark, sf_dir):
    """Balance, margin, profit, equity and margin level of every account, also of those without a position."""
    o = T.table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("account"))
    t = T.trades(spark, sf_dir).select("orderkey", "notional", "pnl")
    p = t.join(o, F.col("orderkey") == F.col("o_orderkey")).groupBy("account").agg((F.sum("notional") / LEVERAGE).alias("margin"), F.sum("pnl").alias("profit"), F.count("*").alias("positions"))
    c = T.table(spark, sf_dir, "customer").join(p, F.col("c_custkey") == F.col("account"), "left")
    profit, margin = F.coalesce("profit", F.lit(0.0)), F.coalesce("margin", F.lit(0.0))
    equity = F.col("c_acctbal") * 100 + profit
    return c.select(
        F.col("c_custkey").alias("account"), F.coalesce("positions", F.lit(0)).alias("positions"), F.round(margin, 3).alias("margin"), F.round(profit, 4).alias("profit"), F.round(equity, 4).alias("equity"),
        F.round(equity - margin, 4).alias("free_margin"), F.round(F.when(margin > 0, 100 * equity / margin), 4).alias("level"),
    )


@query(128, sql=f"""WITH {TRADES}, g AS (SELECT strategy, sum(notional) AS notional FROM trades GROUP BY 1), d AS (SELECT exit_ts, sum(pnl) AS pnl FROM trades GROUP BY 1), e AS (SELECT exit_ts, pnl, {CAPITAL} + sum(pnl) OVER (ORDER BY exit_ts) AS equity FROM d),
p AS (SELECT *, greatest(max(equity) OVER (ORDER BY exit_ts), {CAPITAL}) AS peak FROM e)
SELECT round((SELECT sum(notional) FROM g), 2) AS gross, (SELECT map_from_entries(list((strategy, round(notional, 2)) ORDER BY strategy)) FROM g) AS by_symbol, round(max((peak - equity) / peak), 6) AS drawdown, round(abs(least(quantile_cont(pnl, 0.05), 0)), 2) AS var_95 FROM p""")
def portfolio_exposure(spark, sf_dir):
    """Gross notional and its map by symbol, the deepest fall of the daily equity, and the daily loss that one day in twenty exceeds.
    Notional is added up in decimals: its cents do not depend on the order of rows, as those of a sum of doubles do."""
    t = T.trades(spark, sf_dir)
    whole = lambda x: F.round(F.sum(x).cast("double"), 2)
    g = t.groupBy("strategy").agg(F.sum(F.col("notional").cast("decimal(28,10)")).alias("notional"))
    g = g.agg(whole("notional").alias("gross"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("strategy", F.round(F.col("notional").cast("double"), 2))))).alias("by_symbol"))
    d = t.groupBy("exit_ts").agg(F.sum("pnl").alias("pnl"))  # days
    w = Window.orderBy("exit_ts").rowsBetween(Window.unboundedPreceding, 0)
    e = d.withColumn("equity", CAPITAL + F.sum("pnl").over(w))
    e = e.withColumn("peak", F.greatest(F.max("equity").over(w), F.lit(CAPITAL)))
    r = e.agg(F.round(F.max((F.col("peak") - F.col("equity")) / F.col("peak")), 6).alias("drawdown"), F.round(F.abs(F.least(F.percentile("pnl", 0.05), F.lit(0.0))), 2).alias("var_95"))
    return g.join(F.broadcast(r), F.lit(True))  # a row each
