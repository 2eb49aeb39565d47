"""Queries over research records that the ledgers of research.py leave out: checksums, grouping sets, runs, concepts, JSON."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as TX
from ..functions.scalars import weekend
from ..sources import tables as T
from .base import BARS, DAYS
from .registry import query


@query(133, sql="""WITH y AS (SELECT o_custkey, year(o_orderdate) AS y, sha256(string_agg(o_orderkey || ':' || o_orderstatus, ',' ORDER BY o_orderkey)) AS h FROM orders GROUP BY 1, 2)
SELECT o_custkey AS ledger, sha256(string_agg(h, ',' ORDER BY y)) AS checksum FROM y GROUP BY 1""")
def ledger_checksum(spark, sf_dir):
    """Order-sensitive digest of a ledger by (seq, content), of its years first, so that a long ledger is not gathered whole."""
    o = T.table(spark, sf_dir, "orders")
    joined = lambda pairs: F.array_join(F.transform(F.array_sort(F.collect_list(pairs)), lambda x: x["c"]), ",")
    entry = F.struct(F.col("o_orderkey").alias("k"), F.concat_ws(":", "o_orderkey", "o_orderstatus").alias("c"))
    years = o.groupBy("o_custkey", F.year("o_orderdate").alias("y")).agg(F.sha2(joined(entry), 256).alias("h"))
    return years.groupBy(F.col("o_custkey").alias("ledger")).agg(F.sha2(joined(F.struct(F.col("y").alias("k"), F.col("h").alias("c"))), 256).alias("checksum"))


@query(134, sql="""SELECT coalesce(c_mktsegment, 'all') AS family, coalesce(o_orderstatus, 'all') AS outcome, grouping_id(c_mktsegment, o_orderstatus)::INT AS level, count(*) AS n, round(sum(o_totalprice), 2) AS total
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY GROUPING SETS ((c_mktsegment, o_orderstatus), (c_mktsegment), (o_orderstatus), ())""")
def counts_by_axis(spark, sf_dir):
    """Counts of every axis and of all pairs, from one aggregation."""
    j = T.table(spark, sf_dir, "orders").join(T.table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    g = j.cube("c_mktsegment", "o_orderstatus").agg(F.grouping_id().cast("int").alias("level"), F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    return g.select(F.coalesce("c_mktsegment", F.lit("all")).alias("family"), F.coalesce("o_orderstatus", F.lit("all")).alias("outcome"), "level", "n", "total")


@query(352, sql="""WITH v AS (SELECT o_custkey, o_orderstatus = 'O' AS exploit, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders),
f AS (SELECT o_custkey, coalesce(min(k) FILTER (NOT exploit) - 1, max(k)) AS debt FROM v GROUP BY 1) SELECT o_custkey AS entity, debt, debt >= 3 AS overdue FROM f""")
def exploration_debt(spark, sf_dir):
    """Length of the trailing run of open records: those after the last that is not, counted without ordering a whole history."""
    o = T.table(spark, sf_dir, "orders").select("o_custkey", F.struct("o_orderdate", "o_orderkey").alias("at"), (F.col("o_orderstatus") == "O").alias("exploit"))
    last = o.groupBy("o_custkey").agg(F.max(F.when(~F.col("exploit"), F.col("at"))).alias("last"))
    debt = F.count_if(F.col("last").isNull() | (F.col("at") > F.col("last")))
    return o.join(last, "o_custkey").groupBy(F.col("o_custkey").alias("entity")).agg(debt.alias("debt"), (debt >= 3).alias("overdue"))


@query(428, sql="""WITH f AS (SELECT o_custkey, o_orderpriority AS p, min((o_orderdate, o_orderkey)) AS seen FROM orders GROUP BY 1, 2)
SELECT o_custkey AS entity, string_agg(p, '|' ORDER BY seen) AS rules FROM f GROUP BY 1""")
def rules_in_first_seen_order(spark, sf_dir):
    """Distinct values in the order of their first record; the values are few."""
    o = T.table(spark, sf_dir, "orders")
    f = o.groupBy("o_custkey", F.col("o_orderpriority").alias("p")).agg(F.min(F.struct("o_orderdate", "o_orderkey")).alias("at"))
    rules = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "p"))), lambda x: x["p"]), "|")
    return f.groupBy(F.col("o_custkey").alias("entity")).agg(rules.alias("rules"))


CONCEPTS = {"speed": ("fast", "speed", "quick"), "risk": ("risk", "loss"), "the": ("the ",)}
_SENTENCES = "list_filter(string_split_regex(regexp_replace(coalesce(text, ''), '([.!?])\\s+', '\\1' || chr(10), 'g'), '\\n+'), lambda s: trim(s) <> '')"


@query(230, 231, sql=f"""WITH s AS (SELECT doc_id, {_SENTENCES} AS s FROM documents), c(concept, phrases) AS (VALUES {", ".join(f"('{c}', {list(p)})" for c, p in CONCEPTS.items())}),
m AS (SELECT doc_id, concept, list_position(list_transform(s, lambda x: len(list_filter(phrases, lambda p: contains(lower(x), p))) > 0), true) - 1 AS place, len(s) AS n FROM s CROSS JOIN c)
SELECT doc_id, concept, place::INT AS place, n::INT AS sentences FROM m WHERE place >= 0""")
def concept_extraction(spark, sf_dir):
    """The first sentence of a text that holds a phrase of each concept. The vocabulary is a few phrases, so it is an expression and no text moves."""
    d = T.table(spark, sf_dir, "documents").select("doc_id", TX.sentences(F.col("text")).alias("s"))

    def first(phrases: tuple[str, ...]):
        def has(x):
            low, hit = F.lower(x), F.lit(False)
            for p in phrases:
                hit = hit | low.contains(p)
            return hit

        return (F.array_position(F.transform("s", has), True) - 1).cast("int")

    found = F.array(*[F.struct(F.lit(c).alias("concept"), first(p).alias("place")) for c, p in CONCEPTS.items()])
    return d.select("doc_id", F.size("s").alias("sentences"), F.explode(found).alias("f")).select("doc_id", "f.concept", "f.place", "sentences").filter("place >= 0")


@query(271, sql="""SELECT event_type, count(*) AS n, count(json_extract(props, '$.k')) AS with_k, round(avg(json_extract(props, '$.k')::DOUBLE), 6) AS mean_k, count(json_extract(props, '$.absent')) AS absent FROM events GROUP BY 1""")
def json_parameters(spark, sf_dir):
    k = F.get_json_object("props", "$.k")
    return T.table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count(k).alias("with_k"), F.round(F.avg(k.cast("double")), 6).alias("mean_k"), F.count(F.get_json_object("props", "$.absent")).alias("absent"))


@query(49, sql="SELECT event_id, ts, event_type, value FROM events WHERE event_type IN ('purchase', 'signup') AND value >= 20 AND ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-20'")
def event_pool(spark, sf_dir):
    """Kinds, a least size and a range of time; all three reach the scan."""
    e = T.table(spark, sf_dir, "events")
    return e.filter(F.col("event_type").isin("purchase", "signup") & (F.col("value") >= 20) & F.expr("ts >= timestamp_ntz'2024-01-10' AND ts < timestamp_ntz'2024-01-20'")).select("event_id", "ts", "event_type", "value")


_CLOSED = "((isodow({0}) = 5 AND hour({0}) >= 22) OR isodow({0}) = 6 OR (isodow({0}) = 7 AND hour({0}) < 22))"


@query(416, sql=f"WITH {BARS} SELECT symbol, ts, {_CLOSED.format('ts')} AS closed, len(list_filter(range(-3, 4), lambda k: {_CLOSED.format('(ts + to_hours(k::INT))')} <> {_CLOSED.format('ts')})) > 0 AS near_edge FROM bars")
def weekend_boundary(spark, sf_dir):
    """Whether the market's state changes within three hours either way."""
    now = weekend(F.col("ts"))
    near = F.exists(F.array(*[weekend(F.col("ts") + F.expr(f"INTERVAL {k} HOUR")) for k in range(-3, 4)]), lambda x: x != now)
    return T.bars_1h(spark, sf_dir).select("symbol", "ts", now.alias("closed"), near.alias("near_edge"))


@query(409, sql=f"""WITH {DAYS}, w AS (SELECT symbol, isoyear(date) AS y, weekofyear(date) AS k, max(high) AS high, min(low) AS low, last(close ORDER BY date) AS close FROM days GROUP BY 1, 2, 3),
b AS (SELECT *, max(high) OVER o AS top, min(low) OVER o AS bottom, count(*) OVER o AS n FROM w WINDOW o AS (PARTITION BY symbol ORDER BY y, k ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING))
SELECT symbol, y AS iso_year, k AS iso_week, CASE WHEN n = 2 AND close > top THEN 1 WHEN n = 2 AND close < bottom THEN -1 ELSE 0 END AS signal FROM b""")
def weekly_breakout(spark, sf_dir):
    """Close beyond the channel of the two weeks before."""
    d = T.bars_1d(spark, sf_dir)
    w = d.groupBy("symbol", F.expr("extract(yearofweek from date)").cast("long").alias("iso_year"), F.weekofyear("date").cast("long").alias("iso_week")).agg(
        F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "date").alias("close"))
    o = Window.partitionBy("symbol").orderBy("iso_year", "iso_week").rowsBetween(-2, -1)
    full, c = F.count("*").over(o) == 2, F.col("close")
    return w.select("symbol", "iso_year", "iso_week", F.when(full & (c > F.max("high").over(o)), 1).when(full & (c < F.min("low").over(o)), -1).otherwise(0).alias("signal"))
