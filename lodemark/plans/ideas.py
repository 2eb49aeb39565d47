"""Ideas and what becomes of them: generation by templates, combination in rounds, daily sweeps and suites, delayed entries, classes of results."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import asof
from ..operators.chains import cut_lineage
from ..sources import files
from ..sources import tables as T
from .base import BARS, DAYS, TICKS, TRADES
from .registry import query

#: Drivers, targets and conditioners are nations of these regions; how deep ideas go, and how many grow from one.
ROLES = {"driver": ("AMERICA", "ASIA"), "target": ("EUROPE", "AFRICA"), "conditioner": ("MIDDLE EAST",)}
DEPTH, EACH = 2, 3

_CONCEPTS = f"""c AS (SELECT n_nationkey AS id, CASE {" ".join(f"WHEN r_name IN ({', '.join(repr(n) for n in names)}) THEN '{k}'" for k, names in ROLES.items())} END AS role FROM nation JOIN region ON n_regionkey = r_regionkey),
src AS (SELECT c_nationkey AS id, c_mktsegment AS source FROM customer GROUP BY 1, 2 HAVING avg(c_acctbal) > 4800), edge AS (SELECT DISTINCT s_nationkey AS a, c_nationkey AS b FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE l_returnflag = 'R' AND l_quantity >= 49),
shared AS (SELECT DISTINCT x.id AS a, y.id AS b FROM src x JOIN src y ON x.source = y.source),
pairs AS (SELECT d.id AS driver, t.id AS target, EXISTS (SELECT 1 FROM edge WHERE a = d.id AND b = t.id) AS by_edge, EXISTS (SELECT 1 FROM shared WHERE a = d.id AND b = t.id) AS by_source FROM c d, c t WHERE d.role = 'driver' AND t.role = 'target'),
ideas AS (SELECT 'PAIR' AS template, driver, target, -1 AS conditioner, by_edge, by_source FROM pairs WHERE by_edge OR by_source
  UNION ALL SELECT 'CONDITIONED', p.driver, p.target, k.id, p.by_edge, p.by_source FROM pairs p, c k WHERE (by_edge OR by_source) AND k.role = 'conditioner' AND EXISTS (SELECT 1 FROM shared WHERE a = k.id AND b = p.target))"""


def concepts(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(id, role) of concepts, (id, source) of what they came from, and the allowed edges (a, b)."""
    region, nation = T.table(spark, sf_dir, "region"), T.table(spark, sf_dir, "nation")
    role = F.coalesce(*[F.when(F.col("r_name").isin(*names), k) for k, names in ROLES.items()])
    c = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("id"), role.alias("role"))
    customer = T.table(spark, sf_dir, "customer")
    sources = customer.groupBy(F.col("c_nationkey").alias("id"), F.col("c_mktsegment").alias("source")).agg(F.avg("c_acctbal").alias("m")).filter("m > 4800").select("id", "source")
    lines = T.table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R' AND l_quantity >= 49").select("l_suppkey", "l_orderkey")
    orders, supplier = T.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), T.table(spark, sf_dir, "supplier")
    met = lines.join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customer, F.col("o_custkey") == F.col("c_custkey"))
    return c, sources, met.select(F.col("s_nationkey").alias("a"), F.col("c_nationkey").alias("b")).distinct()


def generated(spark, sf_dir) -> DataFrame:
    """Bindings of both templates. Pairs come out of the edges and of shared sources by joins on them, so no pair without either is built."""
    c, sources, edges = concepts(spark, sf_dir)
    shared = cut_lineage(sources.withColumnRenamed("id", "a").join(sources.withColumnRenamed("id", "b"), "source").select("a", "b").distinct())
    links = edges.withColumn("by_edge", F.lit(True)).join(shared.withColumn("by_source", F.lit(True)), ["a", "b"], "full")
    of = lambda role, name: c.filter(F.col("role") == role).select(F.col("id").alias(name))
    pairs = links.join(of("driver", "a"), "a").join(of("target", "b"), "b").select(F.col("a").alias("driver"), F.col("b").alias("target"), F.coalesce("by_edge", F.lit(False)).alias("by_edge"), F.coalesce("by_source", F.lit(False)).alias("by_source"))
    near = shared.join(of("conditioner", "a"), "a").select(F.col("a").alias("conditioner"), F.col("b").alias("target"))
    one = pairs.select(F.lit("PAIR").alias("template"), "driver", "target", F.lit(-1).alias("conditioner"), "by_edge", "by_source")
    return one.unionByName(pairs.join(near, "target").select(F.lit("CONDITIONED").alias("template"), "driver", "target", "conditioner", "by_edge", "by_source"))


@query(435, sql=f"WITH {_CONCEPTS} SELECT template, driver, target, conditioner, by_edge, by_source FROM ideas")
def idea_generation(spark, sf_dir):
    """Driver and target, and with a conditioner: kept where an allowed edge leads from one to the other or both come from one source."""
    return generated(spark, sf_dir)


def _round_sql(name: str, before: str) -> str:
    return f"""{name}x AS (SELECT i.legs, i.target, k.id AS added, CASE WHEN list_contains(i.legs, k.id) OR k.id = i.target THEN 'already_bound' WHEN k.role = 'target' THEN 'wrong_role' WHEN k.id < list_max(i.legs) THEN 'other_order'
  WHEN NOT EXISTS (SELECT 1 FROM edge WHERE a = k.id AND b = i.target) THEN 'no_edge' WHEN NOT EXISTS (SELECT 1 FROM shared WHERE a = k.id AND b = i.legs[1]) THEN 'no_shared_source' END AS reason FROM {before} i, c k),
{name}r AS (SELECT *, CASE WHEN reason IS NULL AND row_number() OVER (PARTITION BY legs, target, reason IS NULL ORDER BY added) > {EACH} THEN 'enough_of_this_idea' ELSE reason END AS why FROM {name}x),
{name} AS (SELECT list_append(legs, added) AS legs, target FROM {name}r WHERE why IS NULL)"""


@query(436, sql=f"""WITH {_CONCEPTS}, r0 AS (SELECT [driver] AS legs, target FROM ideas WHERE template = 'PAIR'), {_round_sql('r1', 'r0')}, {_round_sql('r2', 'r1')},
a AS (SELECT 1 AS depth, coalesce(why, 'made') AS outcome FROM r1r UNION ALL SELECT 2, coalesce(why, 'made') FROM r2r UNION ALL SELECT 3, 'max_depth_reached' FROM r2)
SELECT depth, outcome, count(*) AS candidates FROM a GROUP BY 1, 2""")
def idea_combination(spark, sf_dir):
    """A fixed point in rounds: each round adds one concept to what the last one made; every candidate dropped has exactly one reason, that
    of the first screen it fails, and ideas of full depth are not grown."""
    c, sources, edges = concepts(spark, sf_dir)
    shared = sources.withColumnRenamed("id", "a").join(sources.withColumnRenamed("id", "b"), "source").select(F.col("a").alias("added"), F.col("b").alias("_first"), F.lit(True).alias("_near")).distinct()
    edges = edges.select(F.col("a").alias("added"), F.col("b").alias("target"), F.lit(True).alias("_edge"))
    base = cut_lineage(generated(spark, sf_dir).filter("template = 'PAIR'").select(F.array("driver").alias("legs"), "target"))
    choices = c.agg(F.collect_list(F.struct(F.col("id").alias("added"), "role")).alias("all"))  # the nations
    out = []
    for depth in range(1, DEPTH + 1):
        tries = base.join(F.broadcast(choices), F.lit(True)).select("legs", "target", F.inline("all")).withColumn("_first", F.col("legs")[0])
        tries = tries.join(edges, ["added", "target"], "left").join(shared, ["added", "_first"], "left")
        reason = (
            F.when(F.array_contains("legs", F.col("added")) | (F.col("added") == F.col("target")), "already_bound").when(F.col("role") == "target", "wrong_role")
            .when(F.col("added") < F.array_max("legs"), "other_order").when(F.col("_edge").isNull(), "no_edge").when(F.col("_near").isNull(), "no_shared_source")
        )
        tries = tries.withColumn("reason", reason)
        place = F.row_number().over(Window.partitionBy("legs", "target", F.col("reason").isNull()).orderBy("added"))
        tries = cut_lineage(tries.withColumn("reason", F.when(F.col("reason").isNull() & (place > EACH), "enough_of_this_idea").otherwise(F.col("reason"))))
        out.append(tries.select(F.lit(depth).alias("depth"), F.coalesce("reason", F.lit("made")).alias("outcome")))
        base = tries.filter("reason IS NULL").select(F.array_append("legs", F.col("added")).alias("legs"), "target")
    out.append(base.select(F.lit(DEPTH + 1).alias("depth"), F.lit("max_depth_reached").alias("outcome")))
    got = out[0]
    for more in out[1:]:
        got = got.unionByName(more)
    return got.groupBy("depth", "outcome").agg(F.count("*").alias("candidates"))


#: The daily grid: streaks and breakouts by days, followed or faded, and weekdays; days held; the cost of a trade.
STREAKS, BREAKOUTS, HOLDS, COST = (2, 3), (3, 5), (1, 2), 0.01


def _daily_sides() -> list[tuple[str, int, str]]:
    """(family, parameter, SQL of the side that it takes on a day of the window w)."""
    streak = lambda k: f"CASE WHEN {' AND '.join(f'lag(close, {j}) OVER w > lag(close, {j + 1}) OVER w' if j else 'close > lag(close) OVER w' for j in range(k))} THEN 1 WHEN {' AND '.join(f'lag(close, {j}) OVER w < lag(close, {j + 1}) OVER w' if j else 'close < lag(close) OVER w' for j in range(k))} THEN -1 ELSE 0 END"
    reach = lambda n: f"CASE WHEN lag(close, {n}) OVER w IS NULL THEN 0 WHEN close > greatest({', '.join(f'lag(high, {j}) OVER w' for j in range(1, n + 1))}) THEN 1 WHEN close < least({', '.join(f'lag(low, {j}) OVER w' for j in range(1, n + 1))}) THEN -1 ELSE 0 END"
    return [*[("STREAK", k, streak(k)) for k in STREAKS], *[("BREAKOUT", n, reach(n)) for n in BREAKOUTS], *[("WEEKDAY", d, f"CASE WHEN weekday_ = {d} THEN 1 ELSE 0 END") for d in range(5)]]


_SWEEP = f"""{DAYS}, r AS (SELECT symbol, date, high, low, close, (isodow(date) - 1)::INT AS weekday_, row_number() OVER w AS i, count(*) OVER (PARTITION BY symbol) AS len, {", ".join(f"ln(lead(close, {h}) OVER w / close) AS f{h}" for h in HOLDS)} FROM days WINDOW w AS (PARTITION BY symbol ORDER BY date)),
s AS (SELECT *, {", ".join(f"{sql} AS s{n}" for n, (_, _, sql) in enumerate(_daily_sides()))} FROM r WINDOW w AS (PARTITION BY symbol ORDER BY date)),
t AS ({" UNION ALL ".join(f"SELECT symbol, i, len, '{family}' AS family, {p} AS parameter, {m} AS mode, {h} AS hold, {m} * s{n} * f{h} - {COST} AS net FROM s WHERE s{n} <> 0 AND f{h} IS NOT NULL" for n, (family, p, _) in enumerate(_daily_sides()) for m in (1, -1) for h in HOLDS)})"""


@query(305, sql=f"""WITH {_SWEEP}
SELECT symbol, family, parameter, mode, hold, count(*) FILTER (i + hold <= floor(0.8 * len)) AS train_n, round(avg(net) FILTER (i + hold <= floor(0.8 * len)), 6) AS train_mean, count(*) FILTER (i > floor(0.8 * len)) AS test_n, round(avg(net) FILTER (i > floor(0.8 * len)), 6) AS test_mean
FROM t GROUP BY 1, 2, 3, 4, 5""")
def daily_sweep(spark, sf_dir):
    """Every family, parameter, direction and holding time on trading days, net of costs: the first four fifths of the days, in which a trade must also end, and the rest."""
    w = Window.partitionBy("symbol").orderBy("date")
    d = T.bars_1d(spark, sf_dir).withColumn("weekday_", F.weekday("date"))
    d.createOrReplaceTempView("_daily_bars")
    sides = ", ".join(f"{sql} AS s{n}" for n, (_, _, sql) in enumerate(_daily_sides()))
    d = spark.sql(f"SELECT *, {sides} FROM _daily_bars WINDOW w AS (PARTITION BY symbol ORDER BY date)")
    spark.catalog.dropTempView("_daily_bars")
    d = d.withColumns({"i": F.row_number().over(w), "len": F.count("*").over(Window.partitionBy("symbol")), **{f"f{h}": F.ln(F.lead("close", h).over(w) / F.col("close")) for h in HOLDS}})
    each = [
        F.struct(F.lit(family).alias("family"), F.lit(p).alias("parameter"), F.lit(m).alias("mode"), F.lit(h).alias("hold"), F.when(F.col(f"s{n}") != 0, m * F.col(f"s{n}") * F.col(f"f{h}") - COST).alias("net"))
        for n, (family, p, _) in enumerate(_daily_sides()) for m in (1, -1) for h in HOLDS
    ]
    t = d.select("symbol", "i", "len", F.inline(F.array(*each))).filter(F.col("net").isNotNull())
    cut = F.floor(0.8 * F.col("len"))
    parts = {"train": F.col("i") + F.col("hold") <= cut, "test": F.col("i") > cut}
    return t.groupBy("symbol", "family", "parameter", "mode", "hold").agg(*[a for k, v in parts.items() for a in (F.count_if(v).alias(f"{k}_n"), F.round(F.avg(F.when(v, F.col("net"))), 6).alias(f"{k}_mean"))])


#: The rule that the daily suite attacks, and its variants: (name, momentum days, days held, days of delay, times the cost).
RULE = (3, 2)
ATTACKS = [("cost_1.5", *RULE, 0, 1.5), ("cost_2", *RULE, 0, 2.0), ("cost_3", *RULE, 0, 3.0), ("delay_1", *RULE, 1, 1.0)]
ATTACKS += [(f"shift_{k}_{h}", k, h, 0, 1.0) for k in (RULE[0] - 1, RULE[0] + 1) for h in (RULE[1] - 1, RULE[1] + 1)]
ATTACKS += [("base", *RULE, 0, 1.0)]


def _attack_sql(name: str, k: int, h: int, delay: int, times: float) -> str:
    at = f"lead(close, {delay}) OVER w" if delay else "close"
    return f"SELECT symbol, '{name}' AS attack, i, len, sign(close - lag(close, {k}) OVER w) * ln(lead(close, {delay + h}) OVER w / {at}) - {times} * {COST} AS net FROM r WINDOW w AS (PARTITION BY symbol ORDER BY date)"


@query(411, sql=f"""WITH {DAYS}, r AS (SELECT symbol, date, close, row_number() OVER (PARTITION BY symbol ORDER BY date) - 1 AS i, count(*) OVER (PARTITION BY symbol) AS len FROM days),
t AS ({" UNION ALL ".join(_attack_sql(*a) for a in ATTACKS)}), v AS (SELECT * FROM t WHERE net IS NOT NULL), m AS (SELECT symbol, attack, avg(net) > 0 AS up FROM v GROUP BY 1, 2),
b AS (SELECT symbol, least(i // greatest(len // 4, 1), 3) AS block, avg(net) > 0 AS up FROM v WHERE attack = 'base' GROUP BY 1, 2),
s AS (SELECT symbol, coalesce(bool_and(up) FILTER (attack LIKE 'cost%'), false) AS costs, coalesce(bool_and(up) FILTER (attack = 'delay_1'), false) AS delay, coalesce(avg(up::INT) FILTER (attack LIKE 'shift%'), 0) >= 0.75 AS shifts FROM m GROUP BY 1)
SELECT symbol, costs, delay, shifts, count(*) FILTER (up) AS positive_blocks, CASE WHEN costs AND delay AND shifts AND count(*) FILTER (up) >= 3 THEN 'SURVIVED' ELSE 'DESTROYED' END AS verdict FROM s JOIN b USING (symbol) GROUP BY symbol, costs, delay, shifts""")
def daily_suite(spark, sf_dir):
    """The rules of the daily suite: all of 1.5, 2 and 3 times the cost stay positive, so does a day's delay, three quarters of the shifts, and three of four blocks, the last of which takes the remainder."""
    w = Window.partitionBy("symbol").orderBy("date")
    c, size = F.col("close"), F.greatest(F.floor(F.col("len") / 4), F.lit(1))
    d = T.bars_1d(spark, sf_dir).select("symbol", "date", "close").withColumns({"i": F.row_number().over(w) - 1, "len": F.count("*").over(Window.partitionBy("symbol"))})
    moves = {f"n{n}": F.signum(c - F.lag(c, k).over(w)) * F.ln(F.lead(c, delay + h).over(w) / (F.lead(c, delay).over(w) if delay else c)) - times * COST for n, (_, k, h, delay, times) in enumerate(ATTACKS)}
    d = d.withColumns(moves)
    each = F.array(*[F.struct(F.lit(name).alias("attack"), F.col(f"n{n}").alias("net")) for n, (name, *_) in enumerate(ATTACKS)])
    v = d.select("symbol", F.least(F.floor(F.col("i") / size), F.lit(3)).alias("block"), F.inline(each)).filter(F.col("net").isNotNull())
    sums = cut_lineage(v.groupBy("symbol", "attack", "block").agg(F.sum("net").alias("s")))
    m = sums.groupBy("symbol", "attack").agg((F.sum("s") > 0).alias("up"), F.count_if(F.col("s") > 0).alias("blocks"))
    every = lambda mark: F.coalesce(F.bool_and(F.when(F.col("attack").startswith(mark), F.col("up"))), F.lit(False))
    shifts = F.coalesce(F.avg(F.when(F.col("attack").startswith("shift"), F.col("up").cast("int"))), F.lit(0.0)) >= 0.75
    got = m.groupBy("symbol").agg(every("cost").alias("costs"), every("delay").alias("delay"), shifts.alias("shifts"), F.max(F.when(F.col("attack") == "base", F.col("blocks"))).alias("positive_blocks"))
    alive = F.col("costs") & F.col("delay") & F.col("shifts") & (F.col("positive_blocks") >= 3)
    return got.filter("positive_blocks IS NOT NULL").withColumn("verdict", F.when(alive, "SURVIVED").otherwise("DESTROYED"))


@query(418, sql=f"""WITH {BARS}, n AS (SELECT symbol, ts, lead(ts) OVER (PARTITION BY symbol ORDER BY ts) AS next FROM bars), m AS (SELECT symbol, next, unnest(generate_series(ts + INTERVAL 1 HOUR, next - INTERVAL 1 HOUR, INTERVAL 1 HOUR)) AS missing FROM n WHERE next > ts + INTERVAL 1 HOUR)
SELECT symbol, missing, date_diff('hour', missing, next) AS hours_to_next FROM m WHERE isodow(missing) <= 5""")
def missing_hours(spark, sf_dir):
    """Each weekday hour without a bar is a row, with the hours to the next bar: their total counts a long gap over and over."""
    w = Window.partitionBy("symbol").orderBy("ts")
    hour = F.expr("INTERVAL 1 HOUR")
    n = T.bars_1h(spark, sf_dir).select("symbol", "ts", F.lead("ts").over(w).alias("next")).filter(F.col("next") > F.col("ts") + hour)
    m = n.select("symbol", "next", F.explode(F.sequence(F.col("ts") + hour, F.col("next") - hour, hour)).alias("missing"))
    return m.filter(F.weekday("missing") < 5).select("symbol", "missing", F.timestamp_diff("HOUR", "missing", "next").alias("hours_to_next"))


@query(438, sql="""WITH g AS (SELECT o_custkey AS id, count(*) FILTER (o_orderstatus = 'F' AND o_totalprice > 400000) AS survivors, count(*) FILTER (o_orderstatus = 'P') AS open, bool_and(o_orderstatus = 'O') AS silent, round(avg(o_totalprice - 230000) / nullif(stddev_samp(o_totalprice) / sqrt(count(*)), 0), 6) AS t FROM orders GROUP BY 1)
SELECT c_custkey AS id, CASE WHEN survivors > 0 THEN 'SURVIVOR' WHEN open > 0 AND t >= 1.5 THEN 'STILL_UNDERPOWERED' WHEN coalesce(silent, true) THEN 'REFUTED' ELSE 'TESTED_FAILED' END AS class FROM customer LEFT JOIN g ON id = c_custkey""")
def memory_classes(spark, sf_dir):
    """The class of every account by all its records; one without records counts as refuted."""
    o, p = T.table(spark, sf_dir, "orders"), F.col("o_totalprice")
    state = F.col("o_orderstatus")
    t = F.round(F.avg(p - 230000) / F.nullif(F.stddev_samp(p) / F.sqrt(F.count("*")), F.lit(0.0)), 6)
    g = o.groupBy(F.col("o_custkey").alias("_id")).agg(F.count_if((state == "F") & (p > 400000)).alias("survivors"), F.count_if(state == "P").alias("open"), F.bool_and(state == "O").alias("silent"), t.alias("t"))
    word = F.when(F.col("survivors") > 0, "SURVIVOR").when((F.col("open") > 0) & (F.col("t") >= 1.5), "STILL_UNDERPOWERED").when(F.coalesce("silent", F.lit(True)), "REFUTED").otherwise("TESTED_FAILED")
    return T.table(spark, sf_dir, "customer").join(g, F.col("c_custkey") == F.col("_id"), "left").select(F.col("c_custkey").alias("id"), word.alias("class"))


@query(442, sql=f"""WITH {TICKS} SELECT user_id, ts::DATE AS day, CASE WHEN bool_or(symbol = 'error') THEN 'ERROR' WHEN bool_or(symbol = 'purchase') THEN 'PRODUCT_CREATED' WHEN bool_or(symbol = 'signup') THEN 'SURVIVOR' ELSE 'NO_EDGE' END AS result, count(*) AS steps FROM ticks GROUP BY 1, 2""")
def cycle_results(spark, sf_dir):
    """The result of a user's day is the gravest of its steps."""
    has = lambda s: F.bool_or(F.col("symbol") == s)
    word = F.when(has("error"), "ERROR").when(has("purchase"), "PRODUCT_CREATED").when(has("signup"), "SURVIVOR").otherwise("NO_EDGE")
    return T.ticks(spark, sf_dir).groupBy("user_id", F.to_date("ts").alias("day")).agg(word.alias("result"), F.count("*").alias("steps"))


_LATER = {"entry": 1, "impulse": 3, "exit": 8}


@query(303, sql=f"""WITH {BARS}, m AS (SELECT seq AS event_id, ts, sign(price - volume) AS side FROM ticks WHERE symbol = 'signup' AND price <> volume), b AS (SELECT ts, close FROM bars WHERE symbol = 'click'),
l AS (SELECT event_id, side, {", ".join(f"(SELECT arg_min(close, b.ts) FROM b WHERE b.ts >= m.ts + INTERVAL {h} HOUR) AS {k}" for k, h in _LATER.items())} FROM m)
SELECT event_id, round(side * ln(exit / entry) - {COST}, 9) AS net FROM l WHERE entry > 0 AND side * ln(impulse / entry) > 0 AND exit IS NOT NULL""")
def delayed_entries(spark, sf_dir):
    """Entered an hour after the event, if the next two hours go the way of its surprise: three as-of probes an event, matched in one pass."""
    t = T.ticks(spark, sf_dir).filter("symbol = 'signup' AND price <> volume")
    m = t.select(F.col("seq").alias("event_id"), "ts", F.signum(F.col("price") - F.col("volume")).alias("side"))
    legs = F.array(*[F.struct(F.lit(k).alias("leg"), F.lit(h).alias("h")) for k, h in _LATER.items()])
    probes = m.select("event_id", "side", "ts", F.inline(legs)).select("event_id", "side", "leg", F.lit("click").alias("symbol"), (F.col("ts") + F.make_dt_interval(hours=F.col("h"))).alias("probe_ts"))
    got = asof.forward(probes, T.bars_1h(spark, sf_dir).filter("symbol = 'click'"), ["close"])
    p = got.groupBy("event_id", "side").pivot("leg", list(_LATER)).agg(F.first("close"))
    move = lambda leg: F.col("side") * F.ln(F.col(leg) / F.col("entry"))
    return p.filter((F.col("entry") > 0) & (move("impulse") > 0) & F.col("exit").isNotNull()).select("event_id", F.round(move("exit") - COST, 9).alias("net"))


@query(9, 10, sql=f"WITH {BARS} SELECT symbol, count(*) AS bars, max(ts) AS last_ts, true AS refused FROM bars WHERE ts < TIMESTAMP '2024-01-24' GROUP BY 1")
def development_bars(spark, sf_dir):
    """Bars written apart, those for development and the sealed rest; the reader takes the one and refuses the other."""
    bars, path = T.bars_1h(spark, sf_dir), files.new_folder(spark, "dev")
    early = F.col("ts") < F.lit("2024-01-24").cast("timestamp_ntz")
    files.write_bars_csv(bars.filter(early), f"{path}/development")
    bars.filter(~early).write.parquet(f"{path}/holdout")
    try:
        files.read_raw_csv(spark, f"{path}/development/../holdout")
        refused = False
    except files.SealedPathError:
        refused = True
    from ..operators.bars import normalise

    dev = normalise(files.read_raw_csv(spark, f"{path}/development").withColumn("seq", F.lit(0)))
    got = cut_lineage(dev.groupBy("symbol").agg(F.count("*").alias("bars"), F.max("ts").alias("last_ts"), F.lit(refused).alias("refused")))
    files.delete(spark, path)
    return got


@query(25, sql=f"WITH {TRADES} SELECT strategy, regime, count(*) AS trades, round(sum(pnl), 4) AS pnl FROM trades GROUP BY 1, 2")
def persisted_trades(spark, sf_dir):
    """One row a trade in folders by strategy, written in two batches of which the second is appended, and read back."""
    t, path = T.trades(spark, sf_dir), files.new_folder(spark, "trades")
    early = F.col("exit_ts") < F.lit("1998-01-01").cast("timestamp_ntz")
    for part in (t.filter(early), t.filter(~early)):
        part.write.mode("append").partitionBy("strategy").parquet(files.allowed(path))
    got = cut_lineage(spark.read.parquet(path).groupBy("strategy", "regime").agg(F.count("*").alias("trades"), F.round(F.sum("pnl"), 4).alias("pnl")))
    files.delete(spark, path)
    return got
