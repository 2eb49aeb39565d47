"""Candidates, populations, resampled statistics, evidence of triples, and histories."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as X
from ..operators import containment as C
from ..operators import draws as D
from ..operators import resampling as R
from ..sources import tables as T
from .base import BARS, TRADES
from .registry import query
from .robustness import daily_results

_SIZES = "z AS (SELECT (SELECT count(*) FROM part) AS a, (SELECT count(*) FROM supplier) AS b, (SELECT count(*) FROM customer) AS c, (SELECT count(*) FROM orders) AS n), h AS (SELECT *, a * b * c AS size, 1::BIGINT << greatest(1, ceil(length(ltrim(bin(a * b * c - 1), '0')) / 2))::INT AS half FROM z)"
_HASH = "('0x' || md5({0})[1:8])::BIGINT"


def _draws_sql(name: str, first: str, last: str) -> str:
    """The rounds written out as one CTE each."""
    out = [f"{name}0 AS (SELECT i, i // half AS l, i % half AS r, h.* FROM (SELECT unnest(range({first}, {last})) AS i FROM h), h)"]
    for k in range(D.ROUNDS):
        step = _HASH.format(f"'7:{k}:' || r")
        out.append(f"{name}{k + 1} AS (SELECT i, r AS l, xor(l, {step} % half) AS r, a, b, c, n, size, half FROM {name}{k})")
    v = "(l * half + r)"
    out.append(f"{name} AS (SELECT i, {v} // (b * c) AS d0, {v} // c % b AS d1, {v} % c AS d2, a, b, c FROM {name}{D.ROUNDS} WHERE {v} < size)")
    return ", ".join(out)


def _space(spark, sf_dir) -> tuple[list[int], int]:
    return [T.table(spark, sf_dir, t).count() for t in ("part", "supplier", "customer")], T.table(spark, sf_dir, "orders").count()


@query(354, sql=f"WITH {_SIZES}, {_draws_sql('d', '0', 'n')} SELECT i, d0, d1, d2 FROM d")
def candidate_draws(spark, sf_dir):
    """As many numbers as there are orders, drawn from all triples of a part, a supplier and a customer, which are never built."""
    sizes, n = _space(spark, sf_dir)
    return D.draws(spark, sizes, 0, n, "7")


@query(353, sql=f"""WITH {_SIZES}, {_draws_sql('d', '0', 'n')}, {_draws_sql('e', 'n', 'n + 100')},
f AS (SELECT i, d0, d1, d2, a, b, c FROM d JOIN part ON p_partkey = d0 JOIN supplier ON s_suppkey = d1 JOIN customer ON c_custkey = d2 ORDER BY round(p_retailprice + s_acctbal - c_acctbal, 2) DESC, i LIMIT 20),
k AS (SELECT *, {_HASH.format("'7:dimension:2:' || i || ':' || child")} % 3 AS j, {_HASH.format("'7:value:2:' || i || ':' || child")} AS v FROM f, (SELECT unnest([1, 2, 3]) AS child))
SELECT 'elite' AS origin, i, 0 AS child, d0, d1, d2 FROM f UNION ALL
SELECT 'child', i, child, CASE WHEN j = 0 THEN (d0 + 1 + v % (a - 1)) % a ELSE d0 END, CASE WHEN j = 1 THEN (d1 + 1 + v % (b - 1)) % b ELSE d1 END, CASE WHEN j = 2 THEN (d2 + 1 + v % (c - 1)) % c ELSE d2 END FROM k UNION ALL
SELECT 'random', i, 0, d0, d1, d2 FROM e""")
def population_step(spark, sf_dir):
    """The second generation: elites of the first, three children of each, and a hundred further numbers."""
    sizes, n = _space(spark, sf_dir)
    part, supplier, customer = (T.table(spark, sf_dir, t) for t in ("part", "supplier", "customer"))
    first = D.draws(spark, sizes, 0, n, "7").join(part, F.col("d0") == F.col("p_partkey")).join(supplier, F.col("d1") == F.col("s_suppkey")).join(customer, F.col("d2") == F.col("c_custkey"))
    scored = first.select("i", "d0", "d1", "d2", F.round(F.col("p_retailprice") + F.col("s_acctbal") - F.col("c_acctbal"), 2).alias("fitness"))
    return D.next_population(scored, D.draws(spark, sizes, n, n + 100, "7"), sizes, 2, "7")


def upper_mean(x: np.ndarray) -> float:
    """The mean of the upper half: a statistic that no aggregate of Spark's offers."""
    return float(np.sort(x)[len(x) // 2 :].mean())


@query(394, 325, sql=f"""WITH {TRADES}, d AS (SELECT strategy, exit_ts, round(sum(pnl), 4) AS x FROM trades GROUP BY 1, 2), a AS (SELECT strategy, list(x ORDER BY exit_ts) AS v FROM d GROUP BY 1),
s AS (SELECT strategy, it, list_sort(list_transform(range(len(v)), lambda i: v[({_HASH.format("'7:' || strategy || ':' || it || ':' || i")} % len(v))::INT + 1])) AS y FROM a, (SELECT unnest(range(1000)) AS it)),
m AS (SELECT strategy, list_avg(y[len(y) // 2 + 1:]) AS v FROM s)
SELECT strategy, count(*) AS resamples, round(quantile_cont(v, 0.025), 4) AS low, round(quantile_cont(v, 0.5), 4) AS mid, round(quantile_cont(v, 0.975), 4) AS high, round(avg((v > 0)::INT), 6) AS positive, avg((v > 0)::INT) >= 0.95 AS survives FROM m GROUP BY 1""")
def statistic_bootstrap(spark, sf_dir):
    """A thousand resamples of daily results under a statistic of the caller's own."""
    got = R.bootstrap(daily_results(spark, sf_dir), "strategy", "i", "x", upper_mean)
    return got.withColumns({c: F.round(c, 4) for c in ("low", "mid", "high")})


@query(316, sql=f"""WITH {BARS}, l AS (SELECT symbol, list(close ORDER BY ts) AS c FROM bars GROUP BY 1), p AS (SELECT b AS base, it, CASE WHEN it = 0 THEN b ELSE greatest(1, floor(b * (1 + 0.25 * ({_HASH.format("'7:lookback:' || b || ':' || it")} / 2147483648 - 1)) + 0.5)) END::INT AS k FROM (SELECT unnest([6.0, 12.0, 24.0]) AS b), (SELECT unnest(range(17)) AS it)),
x AS (SELECT symbol, base, it, k, unnest(list_transform(range(k + 1, len(c)), lambda i: sign(c[i] - c[i - k]) * ln(c[i + 1] / c[i]))) AS r FROM l, p)
SELECT symbol, base, it, k, count(*) AS n, round(sum(r), 6) AS total FROM x GROUP BY 1, 2, 3, 4""")
def parameter_perturbation(spark, sf_dir):
    """Sixteen seeded moves of each look-back by up to a quarter, and the momentum rule's result under each, from one array a series."""
    base = spark.createDataFrame([(6.0,), (12.0,), (24.0,)], "lookback double").withColumn("base", F.col("lookback"))
    p = R.perturbed(base, ["lookback"], 16, 0.25).select("base", "it", F.greatest(F.lit(1.0), F.floor(F.col("lookback") + 0.5)).cast("int").alias("k"))
    c = T.bars_1h(spark, sf_dir).groupBy("symbol").agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "close"))), lambda v: v["close"]).alias("c"))  # bars of a series, bounded by the calendar
    at = F.col("c")
    step = lambda i: F.signum(F.get(at, i) - F.get(at, i - F.col("k"))) * F.ln(F.get(at, i + 1) / F.get(at, i))
    places = F.when(F.size("c") > F.col("k") + 1, F.sequence(F.col("k"), F.size("c") - 2)).otherwise(F.array().cast("array<int>"))
    met = c.join(F.broadcast(p), F.lit(True)).withColumn("r", F.transform(places, step))  # 51 rows
    return met.filter(F.size("r") > 0).select("symbol", "base", "it", "k", F.size("r").cast("long").alias("n"), F.round(F.aggregate("r", F.lit(0.0), lambda a, v: a + v), 6).alias("total"))


# How strong a record's status is.
RANKS = {"UNKNOWN": 1, "KNOWN": 2, "BLOCKED": 3, "UNDERPOWERED": 4, "TESTED": 5, "SURVIVED": 6, "REFUTED": 7}
_STATUS = "CASE WHEN p_retailprice < 905 THEN 'UNKNOWN' WHEN p_retailprice < 930 THEN 'UNDERPOWERED' WHEN p_retailprice < 960 THEN 'TESTED' WHEN p_retailprice < 990 THEN 'SURVIVED' ELSE 'REFUTED' END"


@query(430, sql=f"""WITH r AS (SELECT p_brand AS brand, upper(CASE WHEN p_type = 'PROMO' THEN split_part(p_name, ' ', 2) ELSE p_name || ' ' || p_type END) AS m, {_STATUS} AS status FROM part WHERE p_size > 25),
q AS (SELECT p_partkey AS id, p_brand AS brand, upper(CASE WHEN p_type = 'SMALL' THEN p_name ELSE p_name || ' drive' END) AS m FROM part WHERE p_size <= 25),
j AS (SELECT id, count(*) AS records, max(CASE status {" ".join(f"WHEN '{k}' THEN {v}" for k, v in RANKS.items())} END) AS rank FROM q JOIN r ON q.brand = r.brand AND (contains(q.m, r.m) OR contains(r.m, q.m)) GROUP BY 1)
SELECT id, coalesce(records, 0) AS records, CASE rank {" ".join(f"WHEN {v} THEN '{k}'" for k, v in RANKS.items())} ELSE 'UNEXPLORED' END AS status FROM q LEFT JOIN j USING (id)""")
def triple_evidence(spark, sf_dir):
    """The strongest status among the records of the same brand whose mechanism is part of the proposal's, or the other way round."""
    p = T.table(spark, sf_dir, "part")
    name, kind, price = F.col("p_name"), F.col("p_type"), F.col("p_retailprice")
    status = F.when(price < 905, "UNKNOWN").when(price < 930, "UNDERPOWERED").when(price < 960, "TESTED").when(price < 990, "SURVIVED").otherwise("REFUTED")
    rank = F.coalesce(*[F.when(status == k, v) for k, v in RANKS.items()])
    told = F.upper(F.when(kind == "PROMO", F.split(name, " ")[1]).otherwise(F.concat_ws(" ", name, kind)))
    # copies of a text are one row with their number, so pairs of texts are joined and no pairs of records
    records = p.filter("p_size > 25").groupBy(F.col("p_brand").alias("brand"), told.alias("told")).agg(F.count("*").alias("records"), F.max(rank).alias("rank"))
    asked = F.upper(F.when(kind == "SMALL", name).otherwise(F.concat_ws(" ", name, F.lit("drive"))))
    proposals = p.filter("p_size <= 25").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("brand"), asked.alias("asked"))
    asking = proposals.select("brand", "asked").distinct()
    cols = ["brand", "asked", "told", "records", "rank"]
    both = C.contained(records, asking, "told", "asked", ["brand"]).select(*cols).unionByName(C.contained(asking, records, "asked", "told", ["brand"]).select(*cols)).distinct()
    best = both.groupBy("brand", "asked").agg(F.sum("records").alias("records"), F.max("rank").alias("rank"))
    word = F.coalesce(*[F.when(F.col("rank") == v, k) for k, v in RANKS.items()], F.lit("UNEXPLORED"))
    return proposals.join(best, ["brand", "asked"], "left").select("id", F.coalesce("records", F.lit(0)).alias("records"), word.alias("status"))


@query(40, 41, 42, 43, sql="""WITH e AS (SELECT o_custkey AS account, o_orderkey AS record, o_orderdate AS created, o_orderstatus AS state, o_totalprice AS value, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders)
SELECT account, record, created, state, value, k FROM e WHERE k <= 10""")
def account_histories(spark, sf_dir):
    """Newest first, the last ten records of every account."""
    o = T.table(spark, sf_dir, "orders")
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))
    top = o.withColumn("k", F.row_number().over(w)).filter("k <= 10")  # each task keeps ten rows an account before the shuffle
    return top.select(F.col("o_custkey").alias("account"), F.col("o_orderkey").alias("record"), F.col("o_orderdate").alias("created"), F.col("o_orderstatus").alias("state"), F.col("o_totalprice").alias("value"), "k")



@query(44, sql="SELECT l_orderkey AS id, l_linenumber AS line, l_shipdate AS closed FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_brand = 'Brand#12' AND (l_linestatus = 'O' OR l_shipdate >= (SELECT max(l_shipdate) FROM lineitem) - INTERVAL 365 DAY)")
def position_history(spark, sf_dir):
    """Positions of a symbol that are open or were closed in the last year of the data."""
    li, p = T.table(spark, sf_dir, "lineitem"), T.table(spark, sf_dir, "part").filter("p_brand = 'Brand#12'")
    last = li.agg(F.max("l_shipdate")).first()[0]
    recent = (F.col("l_linestatus") == "O") | (F.col("l_shipdate") >= F.lit(last).cast("timestamp_ntz") - F.expr("INTERVAL 365 DAY"))
    return li.filter(recent).join(p, F.col("l_partkey") == F.col("p_partkey"), "left_semi").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), F.col("l_shipdate").alias("closed"))


#: Cost of a round trip of each symbol, as a share of the price.
COSTS = {"click": 1.0e-4, "error": 1.2e-4, "purchase": 1.4e-4, "signup": 1.9e-4, "view": 2.0e-4}


@query(266, sql=f"""WITH {BARS}, r AS (SELECT symbol, ln(lead(close) OVER (PARTITION BY symbol ORDER BY ts) / close) AS x FROM bars)
SELECT symbol, count(x) AS n, round(avg(x), 9) AS gross, round(avg(x) - max(CASE symbol {" ".join(f"WHEN '{k}' THEN {v}" for k, v in COSTS.items())} END), 9) AS net FROM r GROUP BY 1""")
def net_of_costs(spark, sf_dir):
    """Mean returns less the frozen cost of a round trip; a symbol without one is an error."""
    w = Window.partitionBy("symbol").orderBy("ts")
    r = T.bars_1h(spark, sf_dir).select("symbol", F.ln(F.lead("close").over(w) / F.col("close")).alias("x"))
    g = r.groupBy("symbol").agg(F.count("x").alias("n"), F.avg("x").alias("gross"))
    return g.select("symbol", "n", F.round("gross", 9).alias("gross"), F.round(F.col("gross") - X.round_trip_cost(F.col("symbol"), COSTS), 9).alias("net"))
