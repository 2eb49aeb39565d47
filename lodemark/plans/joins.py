"""Queries of as-of, interval, equi, semi, anti and lineage joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rolling as R
from ..operators import asof
from ..sources import tables as T
from .base import BARS, DAYS, TICKS, TRADES
from .registry import query

def macro_events(spark, sf_dir) -> DataFrame:
    """Releases: one event type; surprise = actual - forecast, null where the forecast is."""
    t = T.ticks(spark, sf_dir).filter(F.col("symbol") == "signup")
    return t.select(F.col("seq").alias("event_id"), "ts", (F.col("user_id") % 7).alias("name"), F.col("price").alias("actual"), F.col("volume").alias("forecast"), (F.col("price") - F.col("volume")).alias("surprise"))


def _probes(spark, sf_dir, symbol: str = "purchase") -> DataFrame:
    return macro_events(spark, sf_dir).select(F.col("event_id").alias("probe_id"), F.lit(symbol).alias("symbol"), F.col("ts").alias("probe_ts"))


@query(56, sql=f"""WITH {BARS}, macro AS (SELECT seq AS event_id, ts FROM ticks WHERE symbol = 'signup')
SELECT event_id AS probe_id, m.ts AS probe_ts, b.ts AS match_ts, b.close FROM macro m ASOF LEFT JOIN (SELECT * FROM bars WHERE symbol = 'purchase') b ON b.ts >= m.ts""")
def asof_forward(spark, sf_dir):
    return asof.forward(_probes(spark, sf_dir), T.bars_1h(spark, sf_dir).filter("symbol = 'purchase'"), ["close"]).select("probe_id", "probe_ts", "match_ts", "close")


@query(57, 58, 15, sql=f"""WITH {BARS}, macro AS (SELECT seq AS event_id, ts FROM ticks WHERE symbol = 'signup')
SELECT event_id AS probe_id, m.ts AS probe_ts, CASE WHEN b.ts <= m.ts + INTERVAL 30 MINUTE THEN b.ts END AS match_30m, CASE WHEN b.ts <= m.ts + INTERVAL 6 HOUR THEN b.close END AS close_6h
FROM macro m ASOF LEFT JOIN (SELECT * FROM bars WHERE symbol = 'purchase') b ON b.ts >= m.ts""")
def asof_forward_tolerance(spark, sf_dir):
    bars = T.bars_1h(spark, sf_dir).filter("symbol = 'purchase'")
    near = asof.forward_tolerance(_probes(spark, sf_dir), bars, 1800, [], hourly=True).withColumnRenamed("match_ts", "match_30m")
    return asof.forward_tolerance(near, bars, 6 * 3600, ["close"], hourly=True).select("probe_id", "probe_ts", "match_30m", F.col("close").alias("close_6h"))


_LEGS = [("entry", 0), ("impulse", 2), ("exit", 8)]


def event_legs(spark, sf_dir, symbols=("purchase", "click")) -> DataFrame:
    """One row per event with the close of each symbol at each leg: probes are exploded, matched in one pass and pivoted back."""
    m = macro_events(spark, sf_dir)
    legs = F.array(*[F.struct(F.lit(s).alias("symbol"), F.lit(n).alias("leg"), F.lit(h).alias("h")) for s in symbols for n, h in _LEGS])
    p = m.withColumn("l", F.explode(legs)).select("event_id", "name", "surprise", "ts", F.col("l.symbol").alias("symbol"), F.concat_ws("_", "l.symbol", "l.leg").alias("leg"), (F.col("ts") + F.make_dt_interval(hours=F.col("l.h"))).alias("probe_ts"))
    p = p.withColumn("probe_id", F.concat_ws(":", "event_id", "leg"))
    got = asof.forward_tolerance(p, T.bars_1h(spark, sf_dir).filter(F.col("symbol").isin(*symbols)), 6 * 3600, ["close"], hourly=True)
    names = [f"{s}_{n}" for s in symbols for n, _ in _LEGS]
    return got.groupBy("event_id", "name", "surprise", "ts").pivot("leg", names).agg(F.first("close"))


LEGS_SQL = f"""{BARS}, {"macro AS (SELECT seq AS event_id, ts, user_id % 7 AS name, price - volume AS surprise FROM ticks WHERE symbol = 'signup')"},
pr AS (SELECT m.*, s.symbol, s.symbol || '_' || l.leg AS leg, m.ts + to_hours(l.h) AS pt FROM macro m, (VALUES ('purchase'), ('click')) s(symbol), (VALUES ('entry', 0), ('impulse', 2), ('exit', 8)) l(leg, h)),
hit AS (SELECT pr.event_id, pr.name, pr.surprise, pr.ts, leg, CASE WHEN b.ts <= pt + INTERVAL 6 HOUR THEN b.close END AS close FROM pr ASOF LEFT JOIN bars b ON pr.symbol = b.symbol AND b.ts >= pr.pt),
legs AS (SELECT event_id, name, surprise, ts, {", ".join(f"max(close) FILTER (leg = '{s}_{n}') AS {s}_{n}" for s in ("purchase", "click") for n in ("entry", "impulse", "exit"))} FROM hit GROUP BY ALL)"""


@query(59, sql=f"WITH {LEGS_SQL} SELECT * FROM legs")
def event_window_join(spark, sf_dir):
    return event_legs(spark, sf_dir)


_MECHANISMS = """round(CASE WHEN surprise > 0 THEN 1 WHEN surprise < 0 THEN -1 ELSE 0 END * ln(purchase_exit / purchase_impulse), 6) AS c2_surprise,
  round(sign(purchase_impulse - purchase_entry) * ln(purchase_exit / purchase_impulse), 6) AS c3_delayed,
  round(-sign(purchase_impulse - purchase_entry) * ln(purchase_exit / purchase_impulse), 6) AS reversal,
  round(CASE WHEN sign(surprise) = sign(click_impulse - click_entry) THEN sign(surprise) * ln(purchase_exit / purchase_impulse) END, 6) AS sc_confirmed,
  round(CASE WHEN sign(surprise) = sign(click_impulse - click_entry) AND sign(surprise) = sign(purchase_impulse - purchase_entry) THEN sign(surprise) * ln(purchase_exit / purchase_impulse) END, 6) AS dual_confirmed"""


@query(294, 295, 297, 298, 299, 300, 302, 269, sql=f"WITH {LEGS_SQL} SELECT event_id, name, {_MECHANISMS}, round(CASE WHEN name IN (1, 3) THEN -sign(surprise) * ln(purchase_exit / purchase_entry) END, 6) AS session_variant FROM legs")
def event_mechanisms(spark, sf_dir):
    """Net log returns of the event mechanisms from one as-of pass."""
    e = event_legs(spark, sf_dir)
    c = F.col
    sign = F.signum("surprise")
    move = F.signum(c("purchase_impulse") - c("purchase_entry"))
    driver = F.signum(c("click_impulse") - c("click_entry"))
    fwd = F.ln(c("purchase_exit") / c("purchase_impulse"))
    r = lambda x, n: F.round(x, 6).alias(n)
    return e.select(
        "event_id", "name", r(F.coalesce(sign, F.lit(0.0)) * fwd, "c2_surprise"), r(move * fwd, "c3_delayed"), r(-move * fwd, "reversal"), r(F.when(sign == driver, sign * fwd), "sc_confirmed"),
        r(F.when((sign == driver) & (sign == move), sign * fwd), "dual_confirmed"), r(F.when(c("name").isin(1, 3), -sign * F.ln(c("purchase_exit") / c("purchase_entry"))), "session_variant"),
    )


@query(296, sql=f"""WITH {LEGS_SQL}, v AS (SELECT * FROM legs WHERE purchase_entry IS NOT NULL AND purchase_impulse IS NOT NULL AND purchase_exit IS NOT NULL)
SELECT event_id, name, round(sign(lag(purchase_impulse - purchase_entry) OVER (PARTITION BY name ORDER BY ts, event_id)) * ln(purchase_exit / purchase_impulse), 6) AS c4_sequence FROM v""")
def event_sequence(spark, sf_dir):
    """Skipped instances do not reset the previous direction, so they are dropped before the lag."""
    v = event_legs(spark, sf_dir).dropna(subset=["purchase_entry", "purchase_impulse", "purchase_exit"])
    w = Window.partitionBy("name").orderBy("ts", "event_id")
    return v.select("event_id", "name", F.round(F.signum(F.lag(F.col("purchase_impulse") - F.col("purchase_entry")).over(w)) * F.ln(F.col("purchase_exit") / F.col("purchase_impulse")), 6).alias("c4_sequence"))


@query(60, 211, 195, sql=f"""WITH {DAYS}, a AS (SELECT date, close, ln(close / lag(close) OVER (ORDER BY date)) AS r FROM days WHERE symbol = 'click'), j AS (
  SELECT b.date, b.close, a.r FROM days b JOIN a USING (date) WHERE b.symbol = 'purchase')
SELECT date, round(sign(r) * ln(lead(close, 3) OVER (ORDER BY date) / close), 6) AS net FROM j""")
def equi_date_pairs(spark, sf_dir):
    """Exits are rows of the joined grid, so the lead comes after the join."""
    d = T.bars_1d(spark, sf_dir)
    w = Window.partitionBy("pair").orderBy("date")
    a = d.filter("symbol = 'click'").select("date", F.lit("p").alias("pair"), F.col("close").alias("dc"))
    a = a.select("date", "pair", R.log_return(F.col("dc"), w).alias("r"))
    j = d.filter("symbol = 'purchase'").select("date", "close").join(a, "date")
    return j.select("date", F.round(F.signum("r") * F.ln(F.lead("close", 3).over(w) / F.col("close")), 6).alias("net"))


@query(61, 194, sql=f"""WITH {BARS}, p AS (SELECT a.ts, a.close AS pa, ln(a.close) - ln(b.close) AS s FROM bars a JOIN bars b USING (ts) WHERE a.symbol = 'click' AND b.symbol = 'purchase'),
z AS (SELECT *, CASE WHEN count(s) OVER w = 50 THEN (s - avg(s) OVER w) / nullif(stddev_samp(s) OVER w, 0) END AS z, lead(pa, 4) OVER (ORDER BY ts) AS ex FROM p WINDOW w AS (ORDER BY ts ROWS BETWEEN 50 PRECEDING AND 1 PRECEDING))
SELECT ts, round(z, 6) AS z, CASE WHEN z >= 2 THEN -1 WHEN z <= -2 THEN 1 ELSE 0 END AS signal, round(CASE WHEN abs(z) >= 2 THEN -sign(z) * ln(ex / pa) - 2 * 0.00085 END, 6) AS net FROM z""")
def pair_spread(spark, sf_dir):
    """z of the log spread against the previous 50; the result is leg A's alone while both legs' costs are charged."""
    b = T.bars_1h(spark, sf_dir)
    a = b.filter("symbol = 'click'").select("ts", F.col("close").alias("pa"))
    o = b.filter("symbol = 'purchase'").select("ts", F.col("close").alias("pb"))
    w = Window.partitionBy("pair").orderBy("ts")
    p = a.join(o, "ts").select("ts", "pa", F.lit("click:purchase").alias("pair"), (F.ln("pa") - F.ln("pb")).alias("s"))
    prev = w.rowsBetween(-50, -1)
    z = R.full(F.col("s"), F.try_divide(F.col("s") - F.avg("s").over(prev), F.nullif(F.stddev_samp("s").over(prev), F.lit(0.0))), w, 50, -1)
    p = p.select("ts", "pa", z.alias("z"), F.lead("pa", 4).over(w).alias("ex"))
    net = F.when(F.abs("z") >= 2, -F.signum("z") * F.ln(F.col("ex") / F.col("pa")) - 2 * 0.00085)
    return p.select("ts", F.round("z", 6).alias("z"), F.when(F.col("z") >= 2, -1).when(F.col("z") <= -2, 1).otherwise(0).alias("signal"), F.round(net, 6).alias("net"))


@query(62, sql=f"""WITH {DAYS}, j AS (SELECT abs(a.close - b.close) / b.close AS d FROM days a JOIN days b USING (date) WHERE a.symbol = 'click' AND b.symbol = 'purchase')
SELECT count(*) AS n, round(list_sort(list(d))[count(*) // 2 + 1], 9) AS upper_median, round(avg((d <= 0.5)::INT), 6) AS within FROM j""")
def cross_source_check(spark, sf_dir):
    from ..operators.stats import upper_median

    d = T.bars_1d(spark, sf_dir)
    a, b = d.filter("symbol = 'click'").select("date", F.col("close").alias("x")), d.filter("symbol = 'purchase'").select("date", F.col("close").alias("y"))
    j = a.join(b, "date").select((F.abs(F.col("x") - F.col("y")) / F.col("y")).alias("d"))
    return j.agg(F.count("*").alias("n"), F.round(upper_median(F.col("d")), 9).alias("upper_median"), F.round(F.avg((F.col("d") <= 0.5).cast("int")), 6).alias("within"))


@query(64, 65, 172, sql=f"""WITH {BARS}, f AS (SELECT symbol, ts, close / lag(close, 3) OVER o - 1 AS mom, (lead(close) OVER o > close)::INT AS label, lead(close, 4) OVER o / close - 1 AS fwd FROM bars WINDOW o AS (PARTITION BY symbol ORDER BY ts))
SELECT symbol, count(*) AS n, round(avg(fwd), 6) AS base_mean, round(avg(fwd) FILTER (mom > 0), 6) AS fired_mean, round(avg((fwd > 0)::INT) FILTER (mom > 0), 6) AS fired_win, round(corr((mom > 0)::INT, fwd), 6) AS ic
FROM f WHERE mom IS NOT NULL AND label IS NOT NULL AND fwd IS NOT NULL GROUP BY symbol""")
def signal_quality(spark, sf_dir):
    """Features and labels aligned on (symbol, ts), rows with any null dropped; then conditional against unconditional forward returns."""
    w, c = R.series("symbol"), F.col("close")
    b = T.bars_1h(spark, sf_dir)
    features = b.select("symbol", "ts", R.relative_momentum(c, 3, w).alias("mom"))
    labels = b.select("symbol", "ts", (F.lead("close").over(w) > c).cast("int").alias("label"), (F.lead("close", 4).over(w) / c - 1).alias("fwd"))
    j = features.join(labels, ["symbol", "ts"]).dropna()
    fired = F.col("mom") > 0
    return j.groupBy("symbol").agg(
        F.count("*").alias("n"), F.round(F.avg("fwd"), 6).alias("base_mean"), F.round(F.avg(F.when(fired, F.col("fwd"))), 6).alias("fired_mean"),
        F.round(F.avg(F.when(fired, (F.col("fwd") > 0).cast("int"))), 6).alias("fired_win"), F.round(F.corr(fired.cast("int"), F.col("fwd")), 6).alias("ic"),
    )


_SPANS = "sp AS (SELECT symbol, seq AS trade_id, ts AS entry, ts + to_hours((2 + seq % 5)::INT) AS exit FROM ticks)"


@query(66, 67, sql=f"""WITH {BARS}, {_SPANS} SELECT b.symbol, b.ts, count(*) AS open_trades, min(trade_id) AS first_trade FROM bars b JOIN sp ON sp.symbol = b.symbol AND b.ts >= sp.entry AND b.ts < sp.exit GROUP BY 1, 2""")
def trade_bar_stamping(spark, sf_dir):
    """Half-open [entry, exit): each trade is exploded to its hours, so the range join is an equi-join on the bar grid."""
    t = T.ticks(spark, sf_dir)
    exit_ = F.col("ts") + F.make_dt_interval(hours=(2 + F.col("seq") % 5).cast("int"))
    hours = F.sequence(F.date_trunc("hour", "ts"), F.date_trunc("hour", exit_), F.expr("INTERVAL 1 HOUR"))
    t = t.select("symbol", F.col("seq").alias("trade_id"), F.col("ts").alias("entry"), exit_.alias("exit"), F.explode(hours).alias("h"))
    t = t.select("symbol", "trade_id", "entry", "exit", F.col("h").cast("timestamp_ntz").alias("ts"))
    j = T.bars_1h(spark, sf_dir).select("symbol", "ts").join(t, ["symbol", "ts"]).filter((F.col("ts") >= F.col("entry")) & (F.col("ts") < F.col("exit")))
    return j.groupBy("symbol", "ts").agg(F.count("*").alias("open_trades"), F.min("trade_id").alias("first_trade"))


@query(68, 188, sql=f"""WITH {BARS}, v AS (SELECT symbol, ts, high - low AS vol FROM bars), q AS (SELECT symbol, quantile_cont(vol, 0.3333) AS a, quantile_cont(vol, 0.6667) AS b FROM v GROUP BY symbol)
SELECT t.symbol, CASE WHEN vol <= a THEN 'low' WHEN vol <= b THEN 'mid' ELSE 'high' END AS regime, CASE WHEN hour(t.ts) < 7 THEN 'asia' WHEN hour(t.ts) < 12 THEN 'london' WHEN hour(t.ts) < 17 THEN 'overlap' ELSE 'late' END AS session,
  count(*) AS n, round(avg(price), 6) AS mean FROM ticks t LEFT JOIN v ON v.symbol = t.symbol AND v.ts = date_trunc('hour', t.ts) JOIN q ON q.symbol = t.symbol GROUP BY 1, 2, 3""")
def regime_and_session(spark, sf_dir):
    from ..functions.scalars import session

    v = T.bars_1h(spark, sf_dir).select("symbol", F.col("ts").alias("hour"), (F.col("high") - F.col("low")).alias("vol"))
    q = F.broadcast(v.groupBy("symbol").agg(F.percentile("vol", F.array(F.lit(0.3333), F.lit(0.6667))).alias("q")))  # a row per symbol
    t = T.ticks(spark, sf_dir).withColumn("hour", T.hour_of(F.col("ts"))).join(v, ["symbol", "hour"], "left").join(q, "symbol")
    regime = F.when(F.col("vol") <= F.get("q", F.lit(0)), "low").when(F.col("vol") <= F.get("q", F.lit(1)), "mid").otherwise("high")
    return t.groupBy("symbol", regime.alias("regime"), session(F.col("ts")).alias("session")).agg(F.count("*").alias("n"), F.round(F.avg("price"), 6).alias("mean"))


@query(73, 74, 420, sql=f"""WITH {TICKS}, a AS (SELECT ts, price, user_id FROM ticks WHERE symbol = 'click'), b AS (SELECT ts, price, user_id FROM ticks WHERE symbol = 'purchase'),
o AS (SELECT (SELECT min(ts) FROM a) AS a0, (SELECT max(ts) FROM a) AS a1, (SELECT min(ts) FROM b) AS b0, (SELECT max(ts) FROM b) AS b1)
SELECT (SELECT count(*) FROM b WHERE EXISTS (SELECT 1 FROM a WHERE a.ts::DATE = b.ts::DATE AND a.user_id = b.user_id)) AS shared, greatest(a0, b0) AS from_ts, least(a1, b1) AS to_ts,
  round(date_diff('second', greatest(a0, b0), least(a1, b1)) / date_diff('second', a0, a1), 6) AS share_of_a, greatest(a0, b0) <= least(a1, b1) AS overlaps FROM o""")
def record_and_interval_overlap(spark, sf_dir):
    """Purchases by users who clicked on the same day (semi: repeats count), and the overlap of the spans; touching ends overlap."""
    t = T.ticks(spark, sf_dir)
    a, b = t.filter("symbol = 'click'"), t.filter("symbol = 'purchase'")
    key = ["user_id", "day"]
    of = lambda d: d.select("user_id", F.to_date("ts").alias("day"))
    shared = of(b).join(of(a), key, "left_semi").agg(F.count("*").alias("shared"))
    span = lambda d, x: d.agg(F.min("ts").alias(f"{x}0"), F.max("ts").alias(f"{x}1"))
    o = span(a, "a").join(span(b, "b"), F.lit(True)).join(shared, F.lit(True))  # one row each
    lo, hi = F.greatest("a0", "b0"), F.least("a1", "b1")
    sec = lambda x: F.unix_seconds(x.cast("timestamp"))
    return o.select("shared", lo.alias("from_ts"), hi.alias("to_ts"), F.round((sec(hi) - sec(lo)) / (sec(F.col("a1")) - sec(F.col("a0"))), 6).alias("share_of_a"), (lo <= hi).alias("overlaps"))


@query(69, 76, 77, sql="""WITH e AS (SELECT l_orderkey AS src, l_partkey AS dst, l_linenumber AS ver, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_partkey) AS k FROM lineitem), latest AS (SELECT * FROM e WHERE k = 1)
SELECT o_orderkey AS hypothesis, o_custkey AS source, c_name AS source_name, count(dst) AS claims, count(p_partkey) AS found, count(dst) - count(p_partkey) AS missing, coalesce(list_sort(list(p_brand) FILTER (p_brand IS NOT NULL)), []) AS brands
FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN latest ON src = o_orderkey LEFT JOIN part p ON dst = p_partkey GROUP BY 1, 2, 3""")
def lineage_trace(spark, sf_dir):
    """Latest edges, then left joins that keep missing references."""
    li = T.table(spark, sf_dir, "lineitem")
    latest = li.groupBy(F.col("l_orderkey").alias("src"), "l_linenumber").agg(F.max_by("l_partkey", F.struct("l_shipdate", -F.col("l_partkey"))).alias("dst"))
    o = T.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    c = T.table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    p = T.table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    j = o.join(c, F.col("o_custkey") == F.col("c_custkey"), "left").join(latest, F.col("o_orderkey") == F.col("src"), "left").join(p, F.col("dst") == F.col("p_partkey"), "left")
    found = F.count("p_partkey")
    return j.groupBy(F.col("o_orderkey").alias("hypothesis"), F.col("o_custkey").alias("source"), F.col("c_name").alias("source_name")).agg(
        F.count("dst").alias("claims"), found.alias("found"), (F.count("dst") - found).alias("missing"), F.sort_array(F.collect_list("p_brand")).alias("brands"))


@query(78, 128, 129, 131, 132, 250, 251, 252, sql=f"""WITH {TICKS}, q AS (SELECT symbol, last(price ORDER BY ts, seq) AS px FROM ticks GROUP BY symbol),
pos AS (SELECT symbol, seq, price AS entry, CASE WHEN seq % 2 = 0 THEN 1 ELSE -1 END AS dir, volume / 100 AS lots FROM ticks)
SELECT symbol, count(*) AS positions, round(sum(dir * lots), 6) AS exposure, round(sum(lots * 100 * px), 4) AS gross_notional,
  round(sum((CASE WHEN dir > 0 THEN px - 0.01 ELSE px + 0.01 END - entry) * dir * 100 * lots), 4) AS open_pnl, round(sum(lots * 100 * px / 30), 4) AS margin FROM pos JOIN q USING (symbol) GROUP BY symbol""")
def revaluation_and_exposure(spark, sf_dir):
    """Long positions at the bid, short ones at the ask."""
    from ..functions import scalars as X

    t = T.ticks(spark, sf_dir)
    q = F.broadcast(t.groupBy("symbol").agg(F.max_by("price", F.struct("ts", "seq")).alias("px")))  # a row per symbol
    pos = t.select("symbol", F.col("price").alias("entry"), F.when(F.col("seq") % 2 == 0, 1).otherwise(-1).alias("dir"), (F.col("volume") / 100).alias("lots")).join(q, "symbol")
    px, c, no = F.col("px"), F.lit(100.0), F.lit(False)
    at = F.when(F.col("dir") > 0, px - 0.01).otherwise(px + 0.01)
    gross = X.notional(px, F.col("lots"), c, no)
    return pos.groupBy("symbol").agg(
        F.count("*").alias("positions"), F.round(F.sum(F.col("dir") * F.col("lots")), 6).alias("exposure"), F.round(F.sum(gross), 4).alias("gross_notional"),
        F.round(F.sum(X.position_pnl(F.col("entry"), at, F.col("dir"), F.col("lots"), c, no)), 4).alias("open_pnl"), F.round(F.sum(gross / 30), 4).alias("margin"),
    )


def position_share(events: DataFrame) -> DataFrame:
    """Adds pr, each event's percent rank by (ts, event_id). Events are counted per hour, and only the counts are summed in one window;
    places inside an hour are numbered by hour."""
    hour = T.hour_of(F.col("ts"))
    counts = events.groupBy(hour.alias("_h")).agg(F.count("*").alias("_k"))
    before = Window.partitionBy().orderBy("_h").rowsBetween(Window.unboundedPreceding, -1)  # a row per hour
    counts = counts.select("_h", F.coalesce(F.sum("_k").over(before), F.lit(0)).alias("_before"), F.sum("_k").over(Window.partitionBy()).alias("_n"))
    placed = events.withColumn("_h", hour).withColumn("_r", F.row_number().over(Window.partitionBy("_h").orderBy("ts", "event_id")))
    return placed.join(counts, "_h").withColumn("pr", F.coalesce(F.try_divide(F.col("_before") + F.col("_r") - 1, F.col("_n") - 1), F.lit(0.0))).drop("_h", "_r", "_before", "_n")


@query(307, 308, 304, 306, 406, sql=f"""WITH {BARS}, macro AS (SELECT seq AS event_id, ts, price - volume AS surprise, percent_rank() OVER (ORDER BY ts, seq) AS pr FROM ticks WHERE symbol = 'signup'),
w AS (SELECT * FROM (VALUES (0, 4), (0, 12), (1, 6), (2, 24)) w(entry_h, exit_h)), s AS (SELECT symbol FROM (VALUES ('purchase'), ('click')) s(symbol)),
pr AS (SELECT m.*, s.symbol, w.*, m.ts + to_hours(entry_h) AS t0, m.ts + to_hours(exit_h) AS t1 FROM macro m, s, w),
a AS (SELECT pr.*, CASE WHEN b.ts <= t0 + INTERVAL 6 HOUR THEN b.close END AS p0 FROM pr ASOF LEFT JOIN bars b ON pr.symbol = b.symbol AND b.ts >= pr.t0),
c AS (SELECT a.*, CASE WHEN b.ts <= t1 + INTERVAL 6 HOUR THEN b.close END AS p1 FROM a ASOF LEFT JOIN bars b ON a.symbol = b.symbol AND b.ts >= a.t1),
r AS (SELECT symbol, entry_h, exit_h, CASE WHEN pr < 0.8 THEN 'train' ELSE 'validation' END AS part, sign(surprise) * ln(p1 / p0) - 0.00085 AS net FROM c WHERE p0 IS NOT NULL AND p1 IS NOT NULL AND surprise <> 0)
SELECT symbol, entry_h, exit_h, part, count(*) AS n, round(avg(net), 6) AS mean, round(avg(net) / (nullif(stddev_samp(net), 0) / sqrt(count(*))), 3) AS t, round(avg((net > 0)::INT), 4) AS win_rate FROM r GROUP BY ALL""")
def event_sweep(spark, sf_dir):
    """Windows x symbols as a parameter table, crossed with the events; entry and exit are looked up by hour; 80/20 by event time."""
    from ..operators.chains import cut_lineage
    from ..operators.stats import t_stat, win_rate

    m = cut_lineage(position_share(macro_events(spark, sf_dir)).filter("surprise <> 0").select("ts", "surprise", "pr"))
    bars = cut_lineage(T.bars_1h(spark, sf_dir).filter(F.col("symbol").isin("purchase", "click")).select("symbol", "ts", "close"))
    grid = F.array(*[F.struct(F.lit(s).alias("symbol"), F.lit(a).alias("entry_h"), F.lit(b).alias("exit_h")) for s in ("purchase", "click") for a, b in ((0, 4), (0, 12), (1, 6), (2, 24))])
    p = m.withColumn("g", F.explode(grid)).select("surprise", "ts", "pr", "g.*")
    for leg, price in (("entry", "p0"), ("exit", "p1")):
        p = p.withColumn("at", F.col("ts") + F.make_dt_interval(hours=F.col(f"{leg}_h")))
        p = asof.forward_tolerance(p, bars, 6 * 3600, ["close"], at="at", hourly=True).withColumnRenamed("close", price).drop("match_ts", "at")
    p = p.dropna(subset=["p0", "p1"])
    net = F.signum("surprise") * F.ln(F.col("p1") / F.col("p0")) - 0.00085
    r = p.select("symbol", "entry_h", "exit_h", F.when(F.col("pr") < 0.8, "train").otherwise("validation").alias("part"), net.alias("net"))
    x = F.col("net")
    return r.groupBy("symbol", "entry_h", "exit_h", "part").agg(F.count("*").alias("n"), F.round(F.avg(x), 6).alias("mean"), F.round(t_stat(x), 3).alias("t"), F.round(win_rate(x), 4).alias("win_rate"))
