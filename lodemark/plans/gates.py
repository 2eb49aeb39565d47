"""Queries of gates, limits and checks that decide on rows one by one, and of event rules that probe before or across series."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import rolling as R
from ..operators import asof
from ..sources import tables as T
from .base import BARS, TICKS
from .joins import macro_events, position_share
from .registry import query

#: Normal quantiles of a two-sided 5 % test and of 80 % power.
Z_ALPHA, Z_POWER = 1.959963984540054, 0.8416212335729143


@query(267, 268, sql=f"""WITH x AS (SELECT p_partkey AS id, p_retailprice / 1000 AS ratio, p_size AS slots, p_partkey % 7 AS debt FROM part),
s AS (SELECT *, CASE WHEN debt >= 3 THEN least(0.6, 0.25 + 0.1 * (debt - 3 + 1)) ELSE 0.25 END AS share FROM x), e AS (SELECT *, CASE WHEN slots > 0 THEN greatest(1, round_even(round(slots * share, 9), 0)) ELSE 0 END::INT AS explore FROM s),
r AS (SELECT *, CASE WHEN slots > explore THEN round_even(round((slots - explore) * 0.3, 9), 0) ELSE 0 END::INT AS recombine FROM e)
SELECT id, ceil(least(greatest(pow({Z_ALPHA + Z_POWER} / (greatest(ratio, 0.01) * 0.05), 2), 200), 5000000))::BIGINT AS sample, explore, recombine, (slots - explore - recombine)::INT AS exploit FROM r""")
def sample_sizes_and_slots(spark, sf_dir):
    """Observations that an effect of so many costs needs, and how slots are split, with more exploration under debt; halves go to even."""
    x = T.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (F.col("p_retailprice") / 1000).alias("ratio"), F.col("p_size").alias("slots"), (F.col("p_partkey") % 7).alias("debt"))
    share = F.when(F.col("debt") >= 3, F.least(F.lit(0.6), 0.25 + 0.1 * (F.col("debt") - 3 + 1))).otherwise(0.25)
    even = lambda c: F.bround(F.round(c, 9), 0)
    x = x.withColumn("explore", F.when(F.col("slots") > 0, F.greatest(F.lit(1.0), even(F.col("slots") * share))).otherwise(0).cast("int"))
    rest = F.col("slots") - F.col("explore")
    x = x.withColumn("recombine", F.when(rest > 0, even(rest * 0.3)).otherwise(0).cast("int"))
    n = F.pow((Z_ALPHA + Z_POWER) / (F.greatest("ratio", F.lit(0.01)) * 0.05), 2)
    return x.select("id", F.ceil(F.least(F.greatest(n, F.lit(200.0)), F.lit(5e6))).alias("sample"), "explore", "recombine", (rest - F.col("recombine")).cast("int").alias("exploit"))


@query(404, sql=f"""WITH {TICKS}, m AS (SELECT user_id % 7 AS name, percent_rank() OVER (ORDER BY ts, seq) AS pr FROM ticks WHERE symbol = 'signup')
SELECT name, count(*) FILTER (pr < 0.8) AS train, count(*) FILTER (pr >= 0.8) AS validation, count(*) FILTER (pr < 0.8) >= 30 AND count(*) FILTER (pr >= 0.8) >= 30 AS feasible FROM m GROUP BY 1""")
def power_precheck(spark, sf_dir):
    """Whether a kind of event has 30 instances in both windows."""
    m = position_share(macro_events(spark, sf_dir))
    train, validation = F.count_if(F.col("pr") < 0.8), F.count_if(F.col("pr") >= 0.8)
    return m.groupBy("name").agg(train.alias("train"), validation.alias("validation"), ((train >= 30) & (validation >= 30)).alias("feasible"))


@query(441, sql="""SELECT o_orderkey AS id, CASE WHEN o_totalprice IS NULL OR o_totalprice <= 0 THEN 'ENTRY' WHEN side > 0 AND NOT (sl < o_totalprice AND o_totalprice < tp) THEN 'SIDE' WHEN side < 0 AND NOT (tp < o_totalprice AND o_totalprice < sl) THEN 'SIDE' ELSE 'OK' END AS verdict
FROM (SELECT *, CASE WHEN o_custkey % 2 = 0 THEN 1 ELSE -1 END AS side, o_totalprice * (1 - (o_orderkey % 5 - 2) / 100.0) AS sl, o_totalprice * (1 + (o_orderkey % 7 - 3) / 100.0) AS tp FROM orders)""")
def level_validators(spark, sf_dir):
    """Stops and targets must lie strictly on their sides of the entry."""
    p, k = F.col("o_totalprice"), F.col("o_orderkey")
    sl, tp = p * (1 - (k % 5 - 2) / 100.0), p * (1 + (k % 7 - 3) / 100.0)
    long = F.col("o_custkey") % 2 == 0
    fine = F.when(long, (sl < p) & (p < tp)).otherwise((tp < p) & (p < sl))
    return T.table(spark, sf_dir, "orders").select(k.alias("id"), F.when(p.isNull() | (p <= 0), "ENTRY").when(~fine, "SIDE").otherwise("OK").alias("verdict"))


_ALLOWED = [("F", "1-URGENT"), ("F", "2-HIGH"), ("O", "1-URGENT"), ("O", "3-MEDIUM"), ("P", "5-LOW")]


@query(421, sql=f"""WITH a(state, action) AS (VALUES {", ".join(f"('{s}', '{x}')" for s, x in _ALLOWED)}),
o AS (SELECT o_orderkey AS id, o_custkey, o_orderstatus AS state, o_orderpriority AS action, CASE WHEN o_orderpriority = '1-URGENT' THEN row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderkey) END AS use FROM orders)
SELECT id, CASE WHEN a.state IS NULL THEN 'DENIED' WHEN use > 1 THEN 'USED' ELSE 'ALLOWED' END AS access FROM o LEFT JOIN a USING (state, action)""")
def access_matrix(spark, sf_dir):
    """Allowed pairs of state and action, of which the urgent one may be used once by each entity."""
    o = T.table(spark, sf_dir, "orders")
    first = o.filter("o_orderpriority = '1-URGENT'").groupBy(F.col("o_custkey").alias("_c")).agg(F.min("o_orderkey").alias("_first"))  # combines on the map side
    pair = F.concat_ws(">", "o_orderstatus", "o_orderpriority")
    used = (F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderkey") > F.col("_first"))
    access = F.when(~pair.isin([f"{s}>{x}" for s, x in _ALLOWED]), "DENIED").when(used, "USED").otherwise("ALLOWED")
    return o.join(first, F.col("o_custkey") == F.col("_c"), "left").select(F.col("o_orderkey").alias("id"), access.alias("access"))


@query(426, sql="""SELECT o_custkey AS entity, arg_max(o_orderstatus, o_orderkey) AS outcome, arg_max(o_orderstatus, o_orderkey) IN ('O', 'P') AS reopenable, arg_max(o_orderpriority, o_orderkey) AS reason FROM orders GROUP BY 1""")
def reopenable_reason(spark, sf_dir):
    """The most recent entry decides."""
    last = F.max_by(F.struct("o_orderstatus", "o_orderpriority"), "o_orderkey")
    g = T.table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("entity")).agg(last.alias("l"))
    return g.select("entity", F.col("l.o_orderstatus").alias("outcome"), F.col("l.o_orderstatus").isin("O", "P").alias("reopenable"), F.col("l.o_orderpriority").alias("reason"))


@query(226, 212, 224, sql="""WITH p AS (SELECT DISTINCT p_brand AS family, p_size AS v FROM part), s AS (SELECT family, list_sort(list(v)) AS v FROM p GROUP BY 1)
SELECT family, len(v) AS parameters, sha256('{"family":"' || family || '","values":[' || array_to_string(v, ',') || ']}') AS checksum FROM s""")
def search_space_checksum(spark, sf_dir):
    """Distinct parameters of a family, each once whatever the order of arrival, as canonical JSON and its digest; the values are few."""
    p = T.table(spark, sf_dir, "part").select(F.col("p_brand").alias("family"), F.col("p_size").alias("v")).distinct()
    s = p.groupBy("family").agg(F.array_sort(F.collect_list("v")).alias("values"))
    return s.select("family", F.size("values").alias("parameters"), F.sha2(F.to_json(F.struct("family", "values")), 256).alias("checksum"))


@query(419, sql="""WITH s AS (SELECT event_id, event_type, ts, value, lag(ts) OVER (PARTITION BY event_type ORDER BY event_id) AS before FROM events)
SELECT event_type, count(*) AS rows, count(*) FILTER (ts < before) AS backwards, count(*) FILTER (ts = before) AS repeated, count(*) FILTER (value IS NULL OR value <= 0) AS invalid,
  CASE WHEN count(*) FILTER (ts <= before) + count(*) FILTER (value IS NULL OR value <= 0) > 0 THEN 'VIOLATION' ELSE 'CLEAN' END AS verdict FROM s GROUP BY 1""")
def artifact_integrity(spark, sf_dir):
    """Times must rise strictly in the order of arrival, and values must be there and positive. Arrivals are cut into blocks of ids, so
    that no series is ordered in one task; a block's first row is compared with the last of the block before it that has one."""
    e = T.table(spark, sf_dir, "events").select("event_id", "event_type", "ts", "value").withColumn("block", F.floor(F.col("event_id") / 1_000_000))
    w = Window.partitionBy("event_type", "block").orderBy("event_id")
    last = e.groupBy("event_type", "block").agg(F.max_by("ts", "event_id").alias("last"))
    blocks = Window.partitionBy("event_type").orderBy("block")  # a row per block
    last = last.select(F.col("event_type").alias("_e"), F.col("block").alias("_b"), F.lag("last").over(blocks).alias("_last"))
    s = e.withColumn("before", F.lag("ts").over(w)).join(last, (F.col("event_type") == F.col("_e")) & (F.col("block") == F.col("_b")))
    before = F.when(F.row_number().over(w) == 1, F.col("_last")).otherwise(F.col("before"))
    s = s.withColumn("before", before)
    bad = F.col("value").isNull() | (F.col("value") <= 0)
    return s.groupBy("event_type").agg(
        F.count("*").alias("rows"), F.count_if(F.col("ts") < F.col("before")).alias("backwards"), F.count_if(F.col("ts") == F.col("before")).alias("repeated"), F.count_if(bad).alias("invalid"),
        F.when(F.count_if(F.col("ts") <= F.col("before")) + F.count_if(bad) > 0, "VIOLATION").otherwise("CLEAN").alias("verdict"),
    )


_LEGS = [("click", "pre", -4), ("click", "at", 0), ("view", "entry", 0), ("view", "impulse", 1), ("error", "entry", 0), ("error", "impulse", 1), ("purchase", "entry", 0), ("purchase", "exit", 12)]
_NAMES = [f"{s}_{n}" for s, n, _ in _LEGS]


@query(293, 301, sql=f"""WITH {BARS}, macro AS (SELECT seq AS event_id, ts, price - volume AS surprise FROM ticks WHERE symbol = 'signup'),
g(symbol, leg, h) AS (VALUES {", ".join(f"('{s}', '{s}_{n}', {h})" for s, n, h in _LEGS)}), p AS (SELECT m.*, g.symbol, leg, ts + to_hours(h) AS probe FROM macro m CROSS JOIN g),
a AS (SELECT p.event_id, surprise, leg, CASE WHEN b.ts <= probe + INTERVAL 6 HOUR THEN b.close END AS c FROM p ASOF LEFT JOIN bars b ON b.symbol = p.symbol AND b.ts >= p.probe),
e AS (SELECT event_id, surprise, {", ".join(f"max(c) FILTER (leg = '{n}') AS {n}" for n in _NAMES)} FROM a GROUP BY 1, 2)
SELECT event_id, round(ln(click_at / click_pre) - 0.00085, 6) AS c1_pre_event,
  round(CASE WHEN surprise <> 0 AND sign(view_impulse - view_entry) = sign(surprise) AND -sign(error_impulse - error_entry) = sign(surprise) THEN sign(surprise) * ln(purchase_exit / purchase_entry) - 0.00085 END, 6) AS dual_driver FROM e""")
def event_drivers(spark, sf_dir):
    """Entered four hours before a release and left at it; and a trade only if two drivers, of which one runs against the price, agree with
    the surprise. All legs are probes of one as-of pass."""
    legs = F.array(*[F.struct(F.lit(s).alias("symbol"), F.lit(f"{s}_{n}").alias("leg"), F.lit(h).alias("h")) for s, n, h in _LEGS])
    p = macro_events(spark, sf_dir).withColumn("g", F.explode(legs)).select("event_id", "surprise", "ts", "g.*")
    p = p.withColumn("probe_ts", F.col("ts") + F.make_dt_interval(hours=F.col("h"))).withColumn("probe_id", F.concat_ws(":", "event_id", "leg"))
    got = asof.forward_tolerance(p, T.bars_1h(spark, sf_dir), 6 * 3600, ["close"], hourly=True)
    e = got.groupBy("event_id", "surprise").pivot("leg", _NAMES).agg(F.first("close"))
    c = F.col
    sign = F.signum("surprise")
    agreed = (sign != 0) & (F.signum(c("view_impulse") - c("view_entry")) == sign) & (-F.signum(c("error_impulse") - c("error_entry")) == sign)
    dual = F.when(agreed, sign * F.ln(c("purchase_exit") / c("purchase_entry")) - 0.00085)
    return e.select("event_id", F.round(F.ln(c("click_at") / c("click_pre")) - 0.00085, 6).alias("c1_pre_event"), F.round(dual, 6).alias("dual_driver"))


@query(164, sql=f"""WITH {BARS}, x AS (SELECT *, row_number() OVER o AS r, close / lag(close, 10) OVER o - 1 AS momentum, ln(close / lag(close) OVER o) AS ret, date_diff('hour', lag(ts) OVER o, ts) AS gap, high - low AS rng FROM bars WINDOW o AS (PARTITION BY symbol ORDER BY ts)),
y AS (SELECT *, CASE WHEN count(ret) OVER w = 20 THEN stddev_samp(ret) OVER w END AS vol, CASE WHEN count(close) OVER w = 20 THEN (close - avg(close) OVER w) / nullif(stddev_pop(close) OVER w, 0) END AS z FROM x WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))
SELECT symbol, ts, round(ret, 9) AS ret, round(momentum, 9) AS momentum, round(vol, 9) AS vol, round(z, 6) AS z, round(rng / close, 9) AS span, r > 20 AS warm, coalesce(gap > 1, false) AS after_gap FROM y""")
def feature_matrix(spark, sf_dir):
    """Ordered features of a bar with its warm-up mask and a mark of the gaps, from one sort of each series."""
    w = R.series("symbol")
    c = F.col("close")
    b = T.bars_1h(spark, sf_dir).select("symbol", "ts", "close", R.log_return(c, w).alias("ret"), R.relative_momentum(c, 10, w).alias("momentum"), R.zscore(c, 20, w).alias("z"),
        ((F.col("high") - F.col("low")) / c).alias("span"), F.row_number().over(w).alias("r"), F.lag("ts").over(w).alias("pt"))
    gap = F.coalesce(F.expr("timestampdiff(HOUR, pt, ts)") > 1, F.lit(False))
    r9 = lambda x, n=9: F.round(x, n)
    return b.select("symbol", "ts", r9(F.col("ret")).alias("ret"), r9(F.col("momentum")).alias("momentum"), r9(R.rolling_std(F.col("ret"), 20, w, sample=True)).alias("vol"), r9(F.col("z"), 6).alias("z"), r9(F.col("span")).alias("span"),
        (F.col("r") > 20).alias("warm"), gap.alias("after_gap"))
