"""Queries of file sources and sinks: tables are written to the shared folder, read back by the reader under test, and the files removed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.bars import normalise
from ..operators.chains import cut_lineage
from ..sources import files, registries
from ..sources import tables as T
from .base import BARS, TICKS
from .registry import query


def _once(spark, path: str, df: DataFrame) -> DataFrame:
    """The result on its own, with the files it came from removed."""
    got = cut_lineage(df)
    files.delete(spark, path)
    return got


@query(1, 7, 28, sql=f"WITH {BARS} SELECT symbol, ts, open, high, low, close, coalesce(volume, 0) AS volume FROM bars")
def csv_bars(spark, sf_dir):
    """Bars as CSV and back through the permissive reader and the cleaning."""
    path = files.new_folder(spark, "bars-csv")
    files.write_bars_csv(T.bars_1h(spark, sf_dir), path)
    return _once(spark, path, normalise(files.read_raw_csv(spark, path).withColumn("seq", F.lit(0))))


@query(8, 6, 24, sql=f"WITH {BARS} SELECT symbol, count(*) AS bars, round(sum(close), 6) AS closes FROM bars GROUP BY 1")
def verified_bars(spark, sf_dir):
    """A cached dataset whose files are registered by checksum when they are written and verified before they are read."""
    path = files.new_folder(spark, "bars-cache")
    T.bars_1h(spark, sf_dir).write.parquet(path)
    registered = cut_lineage(files.checksums(spark, path))
    bars = spark.read.parquet(files.verified(spark, path, registered))
    return _once(spark, path, bars.groupBy("symbol").agg(F.count("*").alias("bars"), F.round(F.sum("close"), 6).alias("closes")))


@query(12, 13, 414, sql=f"""WITH {TICKS}, m AS (SELECT symbol, date_trunc('minute', ts) AS minute, price AS p, seq FROM ticks),
v AS (SELECT * FROM m WHERE seq % 17 <> 0 AND p > 0) SELECT symbol, date_trunc('hour', minute + INTERVAL 5 HOUR) AS ts, max(p) AS high, min(p) AS low, count(*) AS rows FROM v GROUP BY 1, 2""")
def vendor_minutes(spark, sf_dir):
    """Vendor text of minutes in a zone five hours behind UTC, every seventeenth line broken in one of four ways; read and rebuilt to hours."""
    t = T.ticks(spark, sf_dir)
    stamp, p = F.date_format("ts", "yyyyMMddHHmm"), F.col("price").cast("string")
    k = F.col("seq") % 68
    broken = F.when(k == 0, F.concat_ws(",", "symbol", stamp, p)).when(k == 17, F.concat_ws(",", "symbol", F.substring(stamp, 1, 10), p, p, p, p, F.lit("1")))
    broken = broken.when(k == 34, F.concat_ws(",", "symbol", stamp, p, F.lit("-1"), p, p, F.lit("1"))).when(k == 51, F.concat_ws(",", "symbol", stamp, p, p, F.lit("x"), p, F.lit("1")))
    path = files.new_folder(spark, "minutes")
    t.select(F.coalesce(broken, F.concat_ws(",", "symbol", stamp, p, p, p, p, F.lit("1"))).alias("line")).write.text(path)
    m = files.read_vendor_minutes(spark, path, 5)
    return _once(spark, path, m.groupBy("symbol", T.hour_of(F.col("ts")).alias("hour")).agg(F.max("high").alias("high"), F.min("low").alias("low"), F.count("*").alias("rows")).withColumnRenamed("hour", "ts"))


@query(14, sql=f"WITH {BARS} SELECT symbol, ts, close FROM bars WHERE symbol = 'click' AND ts >= TIMESTAMP '2024-01-20' AND ts < TIMESTAMP '2024-02-03'")
def month_folders(spark, sf_dir):
    """Series in folders by month, of which a look-up reads its months."""
    path = files.new_folder(spark, "months")
    files.write_months(T.bars_1h(spark, sf_dir), path)
    return _once(spark, path, files.read_months(spark, path, "click", "2024-01-20", "2024-02-03").select("symbol", "ts", "close"))


@query(1, 28, sql=f"""WITH {BARS}, c AS (SELECT symbol, ts, close, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS k FROM bars WHERE ts <= TIMESTAMP '2024-01-20')
SELECT symbol, ts, close, true AS same_digest FROM c WHERE k <= 100""")
def csv_tail(spark, sf_dir):
    """The last hundred bars up to a time from an ordered export, whose digest is the same when it is written again."""
    bars, paths = cut_lineage(T.bars_1h(spark, sf_dir)), [files.new_folder(spark, "bars-export") for _ in range(2)]
    digests = [files.export_csv(spark, bars, p) for p in paths]
    files.delete(spark, paths[1])
    back = normalise(files.read_raw_csv(spark, paths[0]).withColumn("seq", F.lit(0)))
    got = files.tail(back, F.lit("2024-01-20").cast("timestamp_ntz"), 100)
    return _once(spark, paths[0], got.select("symbol", "ts", "close", F.lit(digests[0] == digests[1]).alias("same_digest")))


@query(11, sql=f"""WITH {BARS} SELECT symbol, count(*) AS bars, min(ts) AS first_ts, max(ts) AS last_ts, max(high) AS high, round(sum(close), 6) AS closes FROM bars GROUP BY 1""")
def asset_files(spark, sf_dir):
    """A vendor's export of every asset: five hours behind UTC, numbers as text, a second header among the rows, and each last bar twice, the
    second time right; cleaned and read as one table with the asset's name from the path."""
    path = files.new_folder(spark, "assets")
    bars = T.bars_1h(spark, sf_dir)
    text = lambda c: F.col(c).cast("string")
    stamp = F.date_format(F.col("ts") - F.expr(f"INTERVAL {files.EST_HOURS} HOUR"), "yyyy-MM-dd HH:mm:ss").alias("Price")
    rows = bars.select("symbol", "ts", F.lit(1).alias("k"), stamp, *[text(c).alias(c.title()) for c in ("open", "high", "low", "close", "volume")])
    ends = rows.groupBy("symbol").agg(F.max_by(F.struct("ts", "Price"), "ts").alias("e")).select("symbol", "e.*")
    wrong = ends.select("symbol", "ts", F.lit(0).alias("k"), "Price", *[F.lit("0.5").alias(c) for c in ("Open", "High", "Low", "Close", "Volume")])
    header = ends.select("symbol", F.lit("1970-01-01").cast("timestamp_ntz").alias("ts"), F.lit(0).alias("k"), *[F.lit(c).alias(c) for c in ("Price", "Open", "High", "Low", "Close", "Volume")])
    every = rows.unionByName(wrong).unionByName(header).repartition("symbol").sortWithinPartitions("symbol", "ts", "k")
    every.drop("ts", "k").write.partitionBy("symbol").parquet(path)
    symbols = [r[0] for r in bars.select("symbol").distinct().collect()]  # one a folder
    moved = [(f"{path}/symbol={s}", s) for s in sorted(symbols)]
    got = files.read_assets(spark, [m[0] for m in moved]).withColumn("symbol", F.regexp_replace("symbol", "^symbol=", ""))
    return _once(spark, path, got.groupBy("symbol").agg(F.count("*").alias("bars"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.max("high").alias("high"), F.round(F.sum("close"), 6).alias("closes")))


@query(12, 117, 414, sql=f"""WITH {TICKS}, l AS (SELECT CASE WHEN symbol = 'error' THEN 'short' WHEN symbol <> 'click' THEN 'other_symbol' WHEN user_id < 3 THEN 'unreadable' WHEN round(price - 5, 2) <= 0 THEN 'not_positive' WHEN volume + 1 > price + 10 THEN 'inconsistent' ELSE 'whole' END AS kind FROM ticks)
SELECT kind, count(*) AS lines FROM l GROUP BY 1""")
def vendor_scan(spark, sf_dir):
    """A vendor's file in which short lines, other symbols, odd stamps, prices of 0 and closes outside the bar stand among the whole lines: how many of each."""
    t = T.ticks(spark, sf_dir)
    stamp = F.when(F.col("user_id") < 3, F.lit("2024-01-01")).otherwise(F.date_format("ts", "yyyyMMddHHmm"))
    p = F.col("price")
    prices = [x.cast("string") for x in (p, p + 10, F.round(p - 5, 2), F.col("volume") + 1)]
    close = F.when(F.col("volume") + 1 < F.round(p - 5, 2), prices[0]).otherwise(prices[3])  # only above the high, not below the low
    line = F.when(F.col("symbol") == "error", F.concat_ws(",", "symbol", stamp, prices[0])).otherwise(F.concat_ws(",", "symbol", stamp, *prices[:3], close, F.lit("1")))
    path = files.new_folder(spark, "vendor")
    t.select(line.alias("line")).write.text(path)
    rows = files.scan_vendor_minutes(spark, path, "click")
    return _once(spark, path, rows.groupBy(F.coalesce("skipped", F.lit("whole")).alias("kind")).agg(F.count("*").alias("lines")))


_RECORD = """'{"a":[1,null,true],"id":' || s_suppkey || ',"nested":{"balance":"' || s_name || '","nation":' || s_nationkey || '}}'"""


@query(20, 22, 23, 224, sql=f"SELECT s_suppkey AS id, record, sha256(record) AS sha256 FROM (SELECT s_suppkey, {_RECORD} AS record FROM supplier)")
def registry_documents(spark, sf_dir):
    """Suppliers as documents of a nation: lists in some files and envelopes in others, keys in another order and spaced; in canonical form."""
    s = T.table(spark, sf_dir, "supplier")
    record = F.concat(F.lit('{ "nested": {"nation":'), "s_nationkey", F.lit(', "balance": "'), "s_name", F.lit('"}, "id" : '), "s_suppkey", F.lit(', "a":[1.0, null,true ] }'))
    docs = s.select("s_nationkey", record.alias("r")).groupBy("s_nationkey").agg(F.concat(F.lit("["), F.array_join(F.collect_list("r"), ",\n"), F.lit("]")).alias("list"))
    form = F.when(F.col("s_nationkey") < 12, F.col("list")).otherwise(F.concat(F.lit('{"records":'), "list", F.lit(', "version": 3}')))
    path = files.new_folder(spark, "documents")
    registries.write_documents(docs.select(form.alias("document")), path)
    got = registries.read_documents(spark, path)
    return _once(spark, path, got.select(F.get_json_object("record", "$.id").cast("long").alias("id"), "record", "sha256"))


@query(22, 31, sql="SELECT n_nationkey AS id, n_name AS name, sha256('{\"id\":' || n_nationkey || ',\"name\":\"' || n_name || '\"}') AS sha256 FROM nation")
def sealed_documents(spark, sf_dir):
    """Documents that carry the digest of their payload, verified when they are read."""
    n = T.table(spark, sf_dir, "nation")
    payload = F.to_json(F.struct(F.col("n_name").alias("name"), F.col("n_nationkey").alias("id")))
    path = files.new_folder(spark, "sealed-registry")
    registries.write_documents(n.select(registries.sealed(payload).alias("document")), path)
    got = registries.read_sealed(spark, path)
    return _once(spark, path, got.select(F.get_json_object("payload", "$.id").cast("int").alias("id"), F.get_json_object("payload", "$.name").alias("name"), F.sha2("payload", 256).alias("sha256")))


@query(212, 224, sql="""WITH e AS (SELECT DISTINCT p_size AS size, p_type AS type FROM part), s AS (SELECT DISTINCT p_size AS size, p_type AS type FROM part WHERE p_brand < 'Brand#15')
SELECT e.size, e.type FROM e ANTI JOIN s ON e.size = s.size AND e.type = s.type""")
def new_parameter_sets(spark, sf_dir):
    """Parameter sets of all parts less those that the lower brands have, by canonical form: written in two orders and with numbers in two forms."""
    p = T.table(spark, sf_dir, "part")
    one = F.concat(F.lit('{"type":"'), "p_type", F.lit('", "at":{"size":'), "p_size", F.lit("}}")).alias("json")
    two = F.concat(F.lit('{"at":{"size":'), "p_size", F.lit('.0},"type":"'), "p_type", F.lit('"}')).alias("json")
    got = registries.new_parameters(p.select(one).unionByName(p.select(two)), p.filter("p_brand < 'Brand#15'").select(two), "json")
    return got.select(F.get_json_object("json", "$.at.size").cast("double").cast("int").alias("size"), F.get_json_object("json", "$.type").alias("type"))


@query(16, sql=f"""WITH {TICKS} SELECT seq::VARCHAR AS event_id, date_trunc('second', ts) AS ts, CASE WHEN price >= 50 THEN 'HIGH' ELSE 'LOW' END AS impact, price AS actual, volume AS forecast, price - volume AS surprise
FROM ticks WHERE symbol = 'signup' AND date_trunc('second', ts) < TIMESTAMP '2024-01-20'""")
def event_calendar(spark, sf_dir):
    """A calendar's file through its gates, cut at the end of the development window."""
    t = T.ticks(spark, sf_dir).filter("symbol = 'signup'")
    path = files.new_folder(spark, "calendar")
    stamp = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z")).alias("timestamp_utc")
    t.select(stamp, F.col("seq").alias("event_id"), F.lit(" signup ").alias("event_name"), F.lit("US").alias("country"), F.lit("usd").alias("currency"), F.when(F.col("price") >= 50, "high").otherwise("low").alias("impact"),
             F.col("price").alias("actual"), F.col("volume").alias("forecast"), F.lit("x").alias("source")).write.option("header", True).csv(path)
    return _once(spark, path, files.read_calendar(spark, path, "2024-01-20").select("event_id", "ts", "impact", "actual", "forecast", "surprise"))


@query(22, sql="SELECT c_custkey AS id, c_name AS name, c_mktsegment AS state FROM customer WHERE c_mktsegment = 'BUILDING'")
def json_registry(spark, sf_dir):
    """A registry of JSON lines, some of them no records."""
    c = T.table(spark, sf_dir, "customer")
    path = files.new_folder(spark, "registry")
    line = F.to_json(F.struct(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("state")))
    c.select(F.explode(F.when(F.col("c_custkey") % 50 == 0, F.array(line, F.lit("{broken"))).otherwise(F.array(line))).alias("value")).write.text(path)
    return _once(spark, path, files.read_registry(spark, path, "id long, name string, state string").filter("state = 'BUILDING'"))


@query(29, 30, 23, sql="SELECT count(*) AS records, count(*) FILTER (o_orderdate >= TIMESTAMP '1997-01-01') AS appended, 0 AS again FROM orders")
def append_store(spark, sf_dir):
    """All orders appended to a store of the earlier ones, and appended again without effect."""
    rows = T.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), "o_orderdate", F.md5(F.concat_ws(":", "o_custkey", "o_orderstatus").cast("binary")).alias("h"))
    path = files.new_folder(spark, "store")
    rows.filter("o_orderdate < timestamp_ntz'1997-01-01'").write.parquet(path)
    first, second = files.append(spark, path, rows, "id", "h"), files.append(spark, path, rows, "id", "h")
    got = spark.read.parquet(path).agg(F.count("*").alias("records")).select("records", F.lit(first).cast("long").alias("appended"), F.lit(second).cast("int").alias("again"))
    return _once(spark, path, got)
