"""Queries over research records: texts, sets, ledgers, budgets and gates."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as X
from ..functions import text as TX
from ..operators import ledger as L
from ..sources import tables as T
from .base import BARS, DAYS
from .registry import query
from .scalars_sql import normal_cdf_sql, ppf_sql, two_sided_p_sql

_TOK = "regexp_extract_all(lower(coalesce({0}, '')), '[a-z0-9]+')"


@query(220, 221, 222, 223, 231, sql=f"""SELECT doc_id, len({_TOK.format('text')}) AS n_tokens, sha256(array_to_string({_TOK.format('text')}, ' ')) AS signature,
  sha256(regexp_replace(array_to_string({_TOK.format('text')}, ' '), '[0-9]+', 'N', 'g')) AS mechanism, 'SRC-' || sha256(coalesce(text, ''))[1:16] AS content_id FROM documents""")
def text_signatures(spark, sf_dir):
    t = F.col("text")
    return T.table(spark, sf_dir, "documents").select("doc_id", F.size(TX.tokens(t)).cast("long").alias("n_tokens"), TX.signature(t).alias("signature"), TX.mechanism_signature(t).alias("mechanism"), TX.content_id("SRC-", F.coalesce(t, F.lit(""))).alias("content_id"))


@query(21, 217, 70, sql="""WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS id FROM documents)
SELECT id, min(doc_id) AS first_seen, count(*) AS copies FROM d GROUP BY id""")
def first_seen_by_content(spark, sf_dir):
    """A known record keeps its first version."""
    d = T.table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("id"))
    return d.groupBy("id").agg(F.min("doc_id").alias("first_seen"), F.count("*").alias("copies"))


@query(213, 216, 71, 225, 424, sql=f"""WITH q AS (SELECT item_id, list_distinct({_TOK.format('text')}) AS a FROM benchmark), s AS (
  SELECT x.item_id AS a, y.item_id AS b, len(list_intersect(x.a, y.a)) / len(list_distinct(list_concat(x.a, y.a)))::DOUBLE AS sim FROM q x JOIN q y ON x.item_id <> y.item_id)
SELECT a, round(max(sim), 6) AS best, arg_max(b, (sim, -b)) AS nearest, CASE WHEN max(sim) >= 1 THEN 'EXACT' WHEN max(sim) >= 0.6 THEN 'NEAR' WHEN max(sim) >= 0.3 THEN 'RELATED' WHEN max(sim) >= 0.01 THEN 'WEAK' ELSE 'NOVEL' END AS class FROM s GROUP BY a""")
def nearest_prior(spark, sf_dir):
    """Best token Jaccard by an inverted index: pairs that share no token are never formed. The stated set is the benchmark items."""
    b = T.table(spark, sf_dir, "benchmark").select("item_id", F.array_distinct(TX.tokens(F.col("text"))).alias("t"))
    return L.nearest_by_tokens(b, "item_id", "t")


@query(214, 215, 423, 425, 72, 218, sql=f"""WITH q AS (SELECT item_id, list_distinct({_TOK.format('text')}) AS t, CASE item_id % 4 WHEN 0 THEN 'REFUTED' WHEN 1 THEN 'UNDERPOWERED' WHEN 2 THEN 'FAILED' ELSE 'OPEN' END AS status FROM benchmark),
s AS (SELECT x.item_id AS a, y.status, len(list_intersect(x.t, y.t)) / len(list_distinct(list_concat(x.t, y.t)))::DOUBLE AS sim FROM q x JOIN q y ON x.item_id <> y.item_id)
SELECT a AS item_id, CASE WHEN max(sim) FILTER (status = 'REFUTED') >= 0.2 THEN 'REFUTED' WHEN max(sim) FILTER (status = 'UNDERPOWERED') >= 0.2 THEN 'UNDERPOWERED' WHEN max(sim) FILTER (status = 'FAILED') >= 0.2 THEN 'FAILED'
  WHEN count(*) FILTER (sim >= 0.15) >= 3 THEN 'REPEATED' WHEN count(*) FILTER (sim >= 0.15) >= 1 THEN 'RARE' ELSE 'NOVEL' END AS tier FROM s GROUP BY a""")
def novelty_tiers(spark, sf_dir):
    """Ordered verdict: near a refuted idea, then an underpowered one, then a failed one; else by how many are alike."""
    b = T.table(spark, sf_dir, "benchmark").select("item_id", F.array_distinct(TX.tokens(F.col("text"))).alias("t"))
    s = L.token_pairs(b, "item_id", "t")
    k = F.col("b") % 4
    best = lambda i: F.max(F.when(k == i, F.col("sim")))
    alike = F.count_if(F.col("sim") >= 0.15)
    tier = F.when(best(0) >= 0.2, "REFUTED").when(best(1) >= 0.2, "UNDERPOWERED").when(best(2) >= 0.2, "FAILED").when(alike >= 3, "REPEATED").when(alike >= 1, "RARE").otherwise("NOVEL")
    got = s.groupBy("a").agg(tier.alias("tier"))
    return b.select("item_id").join(got, F.col("item_id") == F.col("a"), "left").select("item_id", F.coalesce("tier", F.lit("NOVEL")).alias("tier"))


@query(47, 48, 46, 45, sql="""WITH v AS (SELECT o_custkey, o_orderkey, o_orderstatus, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders)
SELECT o_custkey AS entity, o_orderkey AS record, o_totalprice AS priority FROM v WHERE k = 1 AND o_orderstatus = 'O' ORDER BY priority DESC, record LIMIT 100""")
def queue_next(spark, sf_dir):
    """Entities whose latest record is open, the hundred of highest priority (a top-k report)."""
    o = T.table(spark, sf_dir, "orders").withColumnsRenamed({"o_custkey": "entity", "o_orderkey": "record", "o_totalprice": "priority"})
    latest = L.latest(o, ["entity"], [F.col("o_orderdate"), F.col("record")])
    return latest.filter("o_orderstatus = 'O'").select("entity", "record", "priority").orderBy(F.desc("priority"), "record").limit(100)


@query(23, 30, 31, sql="""WITH i AS (SELECT o_orderkey AS id, md5(o_custkey::VARCHAR || ':' || o_orderstatus) AS h FROM orders), s AS (SELECT o_orderkey AS id, md5(o_custkey::VARCHAR || ':' || CASE WHEN o_orderstatus = 'P' THEN 'O' ELSE o_orderstatus END) AS h FROM orders WHERE o_orderdate < TIMESTAMP '1997-01-01'),
n AS (SELECT * FROM i)
SELECT count(*) FILTER (s.id IS NULL) AS appended, count(*) FILTER (s.h = n.h) AS no_ops, count(*) FILTER (s.h <> n.h) AS conflicts FROM n LEFT JOIN s USING (id)""")
def idempotent_append(spark, sf_dir):
    """All orders appended to a store of the earlier ones, in which what is half done now was still open."""
    o = T.table(spark, sf_dir, "orders")
    row = lambda status: (F.col("o_orderkey").alias("id"), F.md5(F.concat_ws(":", "o_custkey", status).cast("binary")).alias("h"))
    store = o.filter("o_orderdate < timestamp_ntz'1997-01-01'").select(*row(F.when(F.col("o_orderstatus") == "P", "O").otherwise(F.col("o_orderstatus"))))
    return L.append_plan(store, o.select(*row(F.col("o_orderstatus"))), "id", "h").agg(F.count_if(F.col("action") == "append").alias("appended"), F.count_if(F.col("action") == "no_op").alias("no_ops"), F.count_if(F.col("action") == "conflict").alias("conflicts"))


@query(120, 209, 122, 124, 427, sql="""WITH g AS (SELECT c_mktsegment AS family, o_orderstatus AS outcome, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
p AS (SELECT family, coalesce(sum(n) FILTER (outcome = 'F'), 0) AS f, coalesce(sum(n) FILTER (outcome = 'O'), 0) AS o, coalesce(sum(n) FILTER (outcome = 'P'), 0) AS p, sum(n) AS n FROM g GROUP BY family)
SELECT family, f::BIGINT AS f, o::BIGINT AS o, p::BIGINT AS p, round(least(2, greatest(0.1, 1 - 0.7 * f / n + 0.8 * o / n)), 6) AS weight, round(n / sum(n) OVER (), 6) AS share, n / sum(n) OVER () >= 0.75 AS concentrated FROM p""")
def family_weights(spark, sf_dir):
    o, c = T.table(spark, sf_dir, "orders"), T.table(spark, sf_dir, "customer")
    j = o.join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_mktsegment").alias("family")).pivot("o_orderstatus", ["F", "O", "P"]).count()
    j = j.select("family", *[F.coalesce(x, F.lit(0)).alias(x.lower()) for x in ("F", "O", "P")]).withColumn("n", F.col("f") + F.col("o") + F.col("p"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy())  # a row per family
    weight = F.least(F.lit(2.0), F.greatest(F.lit(0.1), 1 - 0.7 * F.col("f") / F.col("n") + 0.8 * F.col("o") / F.col("n")))
    return j.select("family", "f", "o", "p", F.round(weight, 6).alias("weight"), F.round(share, 6).alias("share"), (share >= 0.75).alias("concentrated"))


@query(121, 123, 422, 431, sql="""SELECT count(*) AS records, count(DISTINCT o_custkey) AS entities, count(DISTINCT o_orderpriority) AS kinds, count(*) FILTER (o_orderstatus = 'F') AS finished,
 round(sum(o_totalprice), 2) AS volume, round(avg((o_orderstatus <> 'O')::INT), 4) AS coverage, list_sort(list(DISTINCT o_orderpriority)) AS kind_list, 20000 - count(*) AS remaining FROM orders""")
def search_accounting(spark, sf_dir):
    o = T.table(spark, sf_dir, "orders")
    return o.agg(
        F.count("*").alias("records"), F.countDistinct("o_custkey").alias("entities"), F.countDistinct("o_orderpriority").alias("kinds"), F.count_if(F.col("o_orderstatus") == "F").alias("finished"),
        F.round(F.sum("o_totalprice"), 2).alias("volume"), F.round(F.avg((F.col("o_orderstatus") != "O").cast("int")), 4).alias("coverage"),
        F.array_sort(F.collect_set("o_orderpriority")).alias("kind_list"), (20000 - F.count("*")).alias("remaining"),
    )


@query(201, 202, 204, 262, 263, 265, 432, sql="""WITH s AS (SELECT p_partkey AS id, p_brand AS family, p_size, p_retailprice, round(100 * (0.5 * p_size / 50 + 0.3 * (p_partkey % 17) / 17.0 + 0.2 / (1 + p_partkey % 5)), 6) AS score FROM part),
c AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY score DESC, id) AS k FROM s)
SELECT id, family, score, k, CASE WHEN p_retailprice / 1000 >= 1 THEN 'VIABLE' WHEN p_retailprice / 1000 >= 0.25 THEN 'MARGINAL' ELSE 'REJECTED' END AS tier FROM c WHERE k <= 3""")
def idea_ranking(spark, sf_dir):
    """A weighted score, ties by id, at most three of each family."""
    s = T.table(spark, sf_dir, "part")
    score = F.round(100 * (0.5 * F.col("p_size") / 50 + 0.3 * (F.col("p_partkey") % 17) / 17.0 + 0.2 / (1 + F.col("p_partkey") % 5)), 6)
    w = Window.partitionBy("family").orderBy(F.desc("score"), "id")
    value = F.col("p_retailprice") / 1000
    tier = F.when(value >= 1, "VIABLE").when(value >= 0.25, "MARGINAL").otherwise("REJECTED")
    s = s.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("family"), score.alias("score"), tier.alias("tier"))
    return s.withColumn("k", F.row_number().over(w)).filter("k <= 3").select("id", "family", "score", "k", "tier")


@query(50, 51, 52, 219, sql="""WITH r AS (SELECT o_orderkey AS id, list_sort(list(DISTINCT l_linenumber)) AS req FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1),
a AS (SELECT *, list_filter(req, lambda x: x > 4) AS missing FROM r)
SELECT id, len(req) AS required, len(missing) AS missing, CASE WHEN len(missing) > 1 THEN 'BLOCKED' WHEN len(missing) = 1 THEN 'UNCERTAIN' ELSE 'ELIGIBLE' END AS verdict FROM a""")
def eligibility_gate(spark, sf_dir):
    """Required against available sets; any failure blocks, else any doubt is uncertain."""
    li = T.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_set("l_linenumber").alias("req"))
    missing = F.array_except("req", F.array(*[F.lit(i).cast("int") for i in range(1, 5)]))
    li = li.join(T.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id")), "id").withColumn("m", F.size(missing))
    return li.select("id", F.size("req").alias("required"), F.col("m").alias("missing"), F.when(F.col("m") > 1, "BLOCKED").when(F.col("m") == 1, "UNCERTAIN").otherwise("ELIGIBLE").alias("verdict"))


@query(53, 346, 439, 270, sql="""WITH x AS (SELECT c_custkey AS id, c_acctbal AS bal, c_custkey % 11 AS n, (c_custkey % 13) / 4.0 AS t, c_nationkey AS k FROM customer)
SELECT id, array_to_string(list_filter([CASE WHEN bal < 0 THEN 'LOSS' END, CASE WHEN n > 8 THEN 'COUNT' END, CASE WHEN k < 3 THEN 'CORRELATION' END], lambda b: b IS NOT NULL), '|') AS breaches,
  CASE WHEN n < 3 THEN 'INSUFFICIENT_N' WHEN bal < 500 THEN 'COST_FAIL' WHEN t < 1.5 THEN 'WEAK' WHEN t < 2 THEN 'UNDERPOWERED' ELSE 'SURVIVOR' END AS verdict,
  CASE WHEN bal < 0 THEN 'REJECT' WHEN t >= 2 THEN 'ALLOCATE' ELSE 'HOLD' END AS decision, round(least(0.25, greatest(t / 2, 0) * least(n / 5, 1) * 0.5), 6) AS weight FROM x""")
def verdict_ladders(spark, sf_dir):
    c = T.table(spark, sf_dir, "customer")
    bal, n, t = F.col("c_acctbal"), F.col("c_custkey") % 11, (F.col("c_custkey") % 13) / 4.0
    breaches = F.array_compact(F.array(F.when(bal < 0, "LOSS"), F.when(n > 8, "COUNT"), F.when(F.col("c_nationkey") < 3, "CORRELATION")))
    verdict = F.when(n < 3, "INSUFFICIENT_N").when(bal < 500, "COST_FAIL").when(t < 1.5, "WEAK").when(t < 2, "UNDERPOWERED").otherwise("SURVIVOR")
    return c.select(
        F.col("c_custkey").alias("id"), F.array_join(breaches, "|").alias("breaches"), verdict.alias("verdict"), F.when(bal < 0, "REJECT").when(t >= 2, "ALLOCATE").otherwise("HOLD").alias("decision"),
        F.round(F.least(F.lit(0.25), F.greatest(t / 2, F.lit(0.0)) * F.least(n / 5, F.lit(1.0)) * 0.5), 6).alias("weight"),
    )


@query(210, 413, 412, sql="""WITH a AS (SELECT user_id, ts::DATE AS day, event_id FROM events WHERE event_type = 'purchase'), b AS (SELECT user_id, ts::DATE AS day, event_id FROM events WHERE event_type = 'signup'),
c AS (SELECT count(*) AS k FROM (SELECT user_id, day FROM a INTERSECT SELECT user_id, day FROM b)), u AS (SELECT * FROM a UNION ALL SELECT * FROM b)
SELECT (SELECT k FROM c) AS collisions, (SELECT k FROM c) = 0 AS accepted, count(*) AS rows, (SELECT count(*) FROM (SELECT DISTINCT user_id, day FROM u)) AS ids,
  round((SELECT avg((EXISTS (SELECT 1 FROM b WHERE b.user_id = a.user_id AND b.day = a.day))::INT) FROM a), 6) AS agreement FROM u""")
def calendar_merge(spark, sf_dir):
    """Union by name of two calendars, purchases and signups, whose entries are a user's day; any shared entry rejects the whole merge."""
    e = T.table(spark, sf_dir, "events").select("user_id", F.to_date("ts").alias("day"), "event_id", "event_type")
    a, b = (e.filter(F.col("event_type") == x).drop("event_type") for x in ("purchase", "signup"))
    key = ["user_id", "day"]
    shared = a.select(*key).intersect(b.select(*key)).agg(F.count("*").alias("collisions"))
    u = a.unionByName(b)
    u = u.agg(F.count("*").alias("rows")).join(u.select(*key).distinct().agg(F.count("*").alias("ids")), F.lit(True))
    found = a.join(b.select(*key), key, "left_semi").agg(F.count("*").alias("f")).join(a.agg(F.count("*").alias("n")), F.lit(True))
    one = shared.join(u, F.lit(True)).join(found, F.lit(True))  # one row each
    return one.select("collisions", (F.col("collisions") == 0).alias("accepted"), "rows", "ids", F.round(F.try_divide("f", "n"), 6).alias("agreement"))


@query(227, 393, 199, 200, sql="""WITH s AS (SELECT DISTINCT c_mktsegment AS segment FROM customer), p AS (SELECT DISTINCT o_orderpriority AS priority FROM orders),
r AS (SELECT c_mktsegment AS segment, o_orderpriority AS priority, count(*) AS n, round(avg(o_totalprice), 4) AS score FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)
SELECT segment, priority, coalesce(n, 0) AS n, score, row_number() OVER (ORDER BY score DESC NULLS LAST, segment, priority) AS rank, (SELECT count(*) FROM s) * (SELECT count(*) FROM p) AS combinations FROM (s CROSS JOIN p) LEFT JOIN r USING (segment, priority)""")
def strategy_universe_ranking(spark, sf_dir):
    """Names x symbols of two small dimensions, with what was measured, ranked."""
    o, c = T.table(spark, sf_dir, "orders"), T.table(spark, sf_dir, "customer")
    r = o.join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_mktsegment").alias("segment"), F.col("o_orderpriority").alias("priority")).agg(F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 4).alias("score"))
    names, kinds = c.select(F.col("c_mktsegment").alias("segment")).distinct(), o.select(F.col("o_orderpriority").alias("priority")).distinct()
    grid = names.crossJoin(kinds).join(r, ["segment", "priority"], "left").fillna(0, ["n"])  # dimension tables of a few rows
    w = Window.partitionBy().orderBy(F.desc_nulls_last("score"), "segment", "priority")
    return grid.withColumns({"rank": F.row_number().over(w), "combinations": F.count("*").over(Window.partitionBy())})


@query(228, 229, 232, 233, sql="""WITH t AS (SELECT p_partkey AS id, lower(p_name || ' sma rsi stop-loss ' || p_type) AS s FROM part), g AS (
  SELECT id, list_filter([CASE WHEN regexp_matches(s, '\\bsma\\b') THEN 'sma' END, CASE WHEN regexp_matches(s, '\\brsi\\b') THEN 'rsi' END, CASE WHEN regexp_matches(s, 'stop[- ]?loss') THEN 'stop' END], lambda x: x IS NOT NULL) AS tags FROM t)
SELECT id, array_to_string(list_sort(tags), '|') AS signature, len(tags) AS n FROM g""")
def dna_tags(spark, sf_dir):
    text = F.concat_ws("", "p_name", F.lit(" sma rsi stop-loss "), "p_type")
    return T.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), TX.tag_signature(text).alias("signature"), F.size(F.flatten(F.map_values(TX.tags(text)))).alias("n"))


@query(17, 18, 19, 235, 236, 237, 238, 234, sql=f"""WITH e AS (SELECT event_id, event_type, ts, value, user_id, regexp_extract(props, '"k": (-?[0-9]+)', 1)::INT AS k FROM events)
SELECT event_id, date_trunc('minute', ts) + INTERVAL 5 HOUR AS ts, CASE WHEN event_type = 'view' THEN NULL ELSE round(value, 1) * CASE WHEN event_type = 'click' THEN 1000 WHEN event_type = 'purchase' THEN 1e6 ELSE 1 END END AS number,
  CASE WHEN event_type <> 'error' THEN k / 10.0 END AS atr, upper(substr(event_type, 1, 3)) AS base, user_id < 10 OR event_type = 'error' AS is_vague FROM e""")
def text_parsers(spark, sf_dir):
    """Scraped rows made of events, parsed back: local times, numbers with suffixes and signs, exit rules in ATR, base currencies, vague answers."""
    k = F.regexp_extract("props", r'"k": (-?[0-9]+)', 1).cast("int")
    e = T.table(spark, sf_dir, "events").withColumn("k", k)
    kind, v = F.col("event_type"), F.round("value", 1)
    number = F.when(kind == "click", F.concat(v.cast("string"), F.lit("K"))).when(kind == "purchase", F.concat(v.cast("string"), F.lit("M"))).when(kind == "view", F.lit("-")).otherwise(F.concat(v.cast("string"), F.lit("%")))
    rule = F.when(kind == "error", F.lit("at the close")).otherwise(F.concat((F.col("k") / 10).cast("decimal(9,1)").cast("string"), F.lit("x ATR from the entry")))
    answer = F.when(F.col("user_id") < 10, F.lit(" TBD ")).when(kind == "error", F.lit("n/a")).otherwise(F.concat(F.lit("close above "), v.cast("string")))
    raw = e.select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm").alias("local"), number.alias("raw"), rule.alias("rule"), F.concat(F.upper(F.substring(kind, 1, 3)), F.lit("USD")).alias("pair"), answer.alias("answer"))
    stamp = F.to_timestamp_ntz("local", F.lit("yyyy-MM-dd HH:mm")) + F.expr("INTERVAL 5 HOUR")  # a clock without daylight time, five hours behind
    return raw.select("event_id", stamp.alias("ts"), TX.suffixed_number(F.col("raw")).alias("number"), TX.atr_multiple(F.col("rule")).alias("atr"), TX.base_currency(F.col("pair")).alias("base"), TX.vague(F.col("answer")).alias("is_vague"))


_PPF = ppf_sql("p")
_BEST = f"(0.05 * ({1 - X.EULER_GAMMA!r} * {ppf_sql('(1 - 1 / 50.0::DOUBLE)')} + {X.EULER_GAMMA!r} * {ppf_sql(f'(1 - 1 / (50 * {math.e!r}::DOUBLE))')}))"


def _grid_sql(lots: str, step: float, least: float, most: float) -> str:
    on = f"(floor({lots} / {step} + 1e-9) * {step})"
    return f"CASE WHEN {on} < {least} THEN 0 ELSE round(least({on}, {most}), 2) END"


@query(256, 257, 258, 331, 332, 101, 259, 260, 261, 255, 254, 253, 240, 239, 241, 440, sql=f"""WITH x AS (SELECT p_partkey, (p_partkey % 997 + 1) / 999.0::DOUBLE AS p, p_retailprice AS x, p_size / 10.0::DOUBLE AS s FROM part)
SELECT p_partkey, p, {_PPF} AS ppf, {normal_cdf_sql(_PPF)} AS back, {two_sided_p_sql("s")} AS two_sided, {normal_cdf_sql(f"((p / 10 - {_BEST}) * sqrt(249) / sqrt(1 + (3.0 - 1) / 4 * (p / 10) * (p / 10)))")} AS dsr,
  greatest(p - (1 - p), 0) AS kelly, 0.35 + 0.6 * least(greatest(p, 0), 1) AS confidence, floor(x / 0.25 + 1e-9) * 0.25 AS stepped, {_grid_sql("(p * 2)", 0.01, 0.05, 1.5)} AS lots, {_grid_sql("(x * 0.01 / 50)", 0.01, 0.01, 100.0)} AS risk_lots,
  252.0 * 1440 / 60 AS per_year, round_even(least(greatest(x, 950), 1500), 0) AS clipped FROM x""")
def scalar_functions(spark, sf_dir):
    """Normal distribution, sizing and grid functions; held against Python's statistics in tests."""
    p = T.table(spark, sf_dir, "part").select("p_partkey", ((F.col("p_partkey") % 997 + 1) / 999.0).alias("p"), F.col("p_retailprice").alias("x"), (F.col("p_size") / 10.0).alias("s"))
    one = F.lit(1.0)
    return p.select(
        "p_partkey", "p", X.normal_ppf(F.col("p")).alias("ppf"), X.normal_cdf(X.normal_ppf(F.col("p"))).alias("back"), X.two_sided_p(F.col("s")).alias("two_sided"),
        X.deflated_sharpe(F.col("p") / 10, X.expected_max_sharpe(F.lit(50), F.lit(0.05)), F.lit(250), F.lit(0.0), F.lit(3.0)).alias("dsr"), X.kelly(F.col("p"), one).alias("kelly"),
        X.confidence(F.col("p")).alias("confidence"), X.floor_to_step(F.col("x"), F.lit(0.25)).alias("stepped"), X.volume_grid(F.col("p") * 2, 0.01, 0.05, 1.5).alias("lots"),
        X.risk_lots(F.col("x"), 0.01, F.lit(50.0)).alias("risk_lots"), X.bars_per_year(X.timeframe_minutes(F.lit("H1"))).alias("per_year"), X.clip_parameter(F.col("x"), 950.0, 1500.0, True).alias("clipped"),
    )


@query(242, 243, 244, 247, 248, 246, 249, 408, sql=f"""WITH {DAYS}, r AS (SELECT symbol, date, close, isodow(date) = 4 AS is_thursday, month(lead(date) OVER o) <> month(date) AS month_end, month(date) <> month(lag(date) OVER o) AND month(date) IN (1, 4, 7, 10) AS quarter_turn,
  CASE WHEN isodow(date) = 5 AND day(date) <= 7 THEN sign(close - open) ELSE 0 END AS first_friday, round(lead(close, 2) OVER o / close - 1, 6) AS hold_2 FROM days WINDOW o AS (PARTITION BY symbol ORDER BY date))
SELECT symbol, date, is_thursday, month_end, quarter_turn, first_friday, hold_2 FROM r""")
def calendar_signals(spark, sf_dir):
    """Weekday, month and quarter turns on trading-day rows; holds count rows, not days."""
    w = Window.partitionBy("symbol").orderBy("date")
    d = T.bars_1d(spark, sf_dir)
    first_friday = F.when((F.weekday("date") == 4) & (F.dayofmonth("date") <= 7), F.signum(F.col("close") - F.col("open"))).otherwise(0.0)
    return d.select(
        "symbol", "date", (F.weekday("date") == 3).alias("is_thursday"), (F.month(F.lead("date").over(w)) != F.month("date")).alias("month_end"),
        ((F.month("date") != F.month(F.lag("date").over(w))) & F.month("date").isin(1, 4, 7, 10)).alias("quarter_turn"), first_friday.alias("first_friday"), F.round(F.lead("close", 2).over(w) / F.col("close") - 1, 6).alias("hold_2"),
    )


@query(245, sql="""WITH m AS (SELECT DISTINCT date_trunc('month', o_orderdate)::DATE AS d FROM orders), f AS (SELECT d, (d + ((5 - isodow(d) + 7) % 7)::INT)::DATE AS friday FROM m),
b AS (SELECT friday, year(friday) AS y FROM f), s AS (SELECT *, CASE WHEN y < 2007 THEN make_date(y, 4, 1) + ((7 - isodow(make_date(y, 4, 1))) % 7)::INT ELSE make_date(y, 3, 1) + ((7 - isodow(make_date(y, 3, 1))) % 7 + 7)::INT END AS spring,
  CASE WHEN y < 2007 THEN make_date(y, 10, 31) - (isodow(make_date(y, 10, 31)) % 7)::INT ELSE make_date(y, 11, 1) + ((7 - isodow(make_date(y, 11, 1))) % 7)::INT END AS autumn FROM b),
r AS (SELECT friday, friday + CASE WHEN friday >= spring AND friday < autumn THEN INTERVAL '12 hours 30 minutes' ELSE INTERVAL '13 hours 30 minutes' END AS release_utc FROM s)
SELECT friday, release_utc, count(o_orderkey) AS orders, coalesce(round(sum(o_totalprice), 2), 0) AS volume FROM r LEFT JOIN orders ON o_orderdate = friday GROUP BY 1, 2""")
def nfp_calendar(spark, sf_dir):
    """The first Friday of every month that has orders, 08:30 in New York as UTC (an hour earlier in daylight time), and that day's orders."""
    o = T.table(spark, sf_dir, "orders")
    months = o.select(F.trunc("o_orderdate", "month").alias("d")).distinct()
    friday = F.next_day(F.date_sub("d", 1), "Fri")
    local = F.to_timestamp_ntz(F.concat(friday.cast("string"), F.lit(" 08:30:00")))
    m = months.select(friday.alias("friday"), F.convert_timezone(F.lit("America/New_York"), F.lit("UTC"), local).alias("release_utc"))
    days = o.groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count("*").alias("orders"), F.sum("o_totalprice").alias("volume"))
    return m.join(days, F.col("friday") == F.col("day"), "left").select("friday", "release_utc", F.coalesce("orders", F.lit(0)).alias("orders"), F.coalesce(F.round("volume", 2), F.lit(0.0)).alias("volume"))


@query(344, 345, 342, sql="""WITH x AS (SELECT s_suppkey AS id, s_nationkey AS g, greatest(s_acctbal, 1) AS vol FROM supplier), w AS (SELECT *, (1 / vol) / sum(1 / vol) OVER (PARTITION BY g) AS w FROM x)
SELECT id, round(w, 6) AS parity, round(CASE WHEN sum(w * 3) OVER (PARTITION BY g) > 1 THEN w * 3 / sum(w * 3) OVER (PARTITION BY g) ELSE w * 3 END, 6) AS capped FROM w""")
def allocation(spark, sf_dir):
    """Inverse-volatility weights per group, then scaled to a cap of 1."""
    g = Window.partitionBy("g")
    x = T.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("g"), F.greatest("s_acctbal", F.lit(1.0)).alias("vol"))
    x = x.withColumn("w", (1 / F.col("vol")) / F.sum(1 / F.col("vol")).over(g)).withColumn("total", F.sum(F.col("w") * 3).over(g))
    return x.select("id", F.round("w", 6).alias("parity"), F.round(F.when(F.col("total") > 1, F.col("w") * 3 / F.col("total")).otherwise(F.col("w") * 3), 6).alias("capped"))


@query(351, sql="""WITH s AS (SELECT o_custkey AS id, o_orderkey AS k, o_orderstatus AS st, lag(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS p FROM orders), legal(a, b) AS (VALUES ('O', 'P'), ('P', 'F'), ('O', 'F'), ('O', 'O'), ('F', 'F'))
SELECT id, k, p AS from_state, st AS to_state FROM s WHERE p IS NOT NULL AND NOT EXISTS (SELECT 1 FROM legal WHERE a = p AND b = st)""")
def illegal_transitions(spark, sf_dir):
    o = T.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("state"), "o_orderdate")
    legal = [("O", "P"), ("P", "F"), ("O", "F"), ("O", "O"), ("F", "F")]
    return L.illegal_transitions(o, "id", ["o_orderdate", "k"], "state", legal).select("id", "k", "from_state", "to_state")


@query(337, 338, 312, 313, 314, 405, sql=f"""WITH {BARS}, r AS (SELECT symbol, ts, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS r, count(*) OVER (PARTITION BY symbol) AS len FROM bars)
SELECT symbol, CASE WHEN r <= floor(len * 0.6) THEN 'train' WHEN r <= floor(len * 0.6) + floor(len * 0.2) THEN 'validation' ELSE 'holdout' END AS part, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts, md5(string_agg(ts::VARCHAR, ',' ORDER BY r)) AS seal FROM r GROUP BY 1, 2""")
def chronological_split(spark, sf_dir):
    """60/20/20 of each series by position, with a seal over each part's times."""
    from ..operators import splits

    return splits.sealed(splits.chronological(T.bars_1h(spark, sf_dir), "symbol", ["ts"], (0.6, 0.2)), "symbol", "ts", "ts")
