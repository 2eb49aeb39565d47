"""File sources and sinks of market data: CSV bars, vendor minutes, month folders, calendars, registries, append-only stores.

Readers declare their schema and read in permissive mode; what must not be read
is refused before Spark lists it. Checksums are taken where the files are, by
Spark's binary source, and only the list of names that differ comes back.
"""

from __future__ import annotations

import posixpath
import uuid
from urllib.parse import unquote, urlsplit

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.chains import shared_top
from ..operators.ledger import append_plan

#: Folders whose names hold one of these are sealed.
SEALED = ("holdout",)
BAR_COLUMNS = "symbol string, ts string, open string, high string, low string, close string, volume string"
#: Columns and impact levels of an event calendar.
CALENDAR = ("timestamp_utc", "event_id", "event_name", "country", "currency", "impact", "source")
IMPACTS = ("LOW", "MEDIUM", "HIGH")
SHOWN = 20


class SealedPathError(ValueError):
    """A path into sealed evaluation data."""


class DataError(ValueError):
    """Files that fail a gate."""


def allowed(path: str) -> str:
    """The path, if nothing sealed lies on the way to it. Escapes and ".." are resolved first, so neither hides a folder or makes one up."""
    way = posixpath.normpath(unquote(urlsplit(path).path)).casefold()
    found = sorted({name for name in way.split("/") for mark in SEALED if mark in name})
    if found:
        raise SealedPathError(f"{', '.join(found)} on the way to {path}: kept for the final evaluation")
    return path


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the folder that all executors share."""
    return f"{shared_top(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def write_bars_csv(bars: DataFrame, path: str) -> None:
    """CSV with a header; times as text in UTC, so that no reader guesses a zone."""
    text = F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts")
    bars.select("symbol", text, "open", "high", "low", "close", "volume").write.option("header", True).csv(allowed(path))


def read_raw_csv(spark: SparkSession, path: str) -> DataFrame:
    """Every line as text, nothing cleaned, dropped or parsed."""
    return spark.read.schema(BAR_COLUMNS).option("header", True).option("mode", "PERMISSIVE").csv(allowed(path))


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """(name, sha256) of the files below a path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(allowed(path))
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("sha256")).filter("name not like '\\\\_%'")


def verified(spark: SparkSession, path: str, registered: DataFrame) -> str:
    """The path, if its files are those registered (name, sha256), all with their content unchanged."""
    was = registered.select(F.col("name").alias("_name"), F.col("sha256").alias("_sha"))
    got = checksums(spark, path).join(was, F.col("name") == F.col("_name"), "full").filter(~F.col("sha256").eqNullSafe(F.col("_sha")))
    bad = [r[0] for r in got.select(F.coalesce("name", "_name")).limit(SHOWN).collect()]
    if bad:
        raise DataError(f"files differ from the registered ones: {bad}")
    return path


#: Why a vendor line is skipped, in the order of the checks.
SKIPS = ("short", "other_symbol", "unreadable", "not_positive", "inconsistent")


def scan_vendor_minutes(spark: SparkSession, path: str, symbol: str | None = None, offset_hours: int = 0) -> DataFrame:
    """Every `SYMBOL,YYYYMMDDHHmm,open,high,low,close,volume` line without a header, with why it is to be skipped (null: it is whole):
    fields missing, another symbol than the one asked for, no time or number, a price not above 0, a high or low inside the bar.
    offset_hours makes times UTC."""
    names = ("open", "high", "low", "close")
    raw = spark.read.text(allowed(path)).select(F.split("value", ",").alias("f"))
    when = F.when(F.col("f")[1].rlike("^[0-9]{12}$"), F.expr("cast(try_to_timestamp(f[1], 'yyyyMMddHHmm') AS timestamp_ntz)"))
    number = lambda i: F.expr(f"try_cast(get(f, {i}) AS double)")
    got = raw.select(
        F.size("f").alias("_n"), F.get("f", F.lit(0)).alias("symbol"), F.when(F.size("f") > 1, when + F.expr(f"INTERVAL {offset_hours} HOUR")).alias("ts"),
        *[number(i).alias(c) for i, c in enumerate((*names, "volume"), 2)],
    )
    unread = F.greatest(*[F.col(c).isNull() for c in ("ts", *names, "volume")])
    why = F.when(F.col("_n") < 7, SKIPS[0])
    if symbol is not None:
        why = why.when(F.col("symbol") != symbol, SKIPS[1])
    why = why.when(unread, SKIPS[2]).when(F.least(*names) <= 0, SKIPS[3])
    why = why.when((F.col("high") < F.greatest("open", "close")) | (F.col("low") > F.least("open", "close")), SKIPS[4])
    return got.withColumn("skipped", why).drop("_n")


def read_vendor_minutes(spark: SparkSession, path: str, offset_hours: int = 0, symbol: str | None = None) -> DataFrame:
    """symbol, ts, prices and volume of the whole lines."""
    return scan_vendor_minutes(spark, path, symbol, offset_hours).filter(F.col("skipped").isNull()).drop("skipped")


def write_months(bars: DataFrame, path: str) -> None:
    """Folders by symbol, year and month."""
    parts = {"year": F.year("ts"), "month": F.month("ts")}
    bars.withColumns(parts).repartition("symbol", "year", "month").write.partitionBy("symbol", "year", "month").parquet(allowed(path))


def read_months(spark: SparkSession, path: str, symbol: str, since: str, until: str) -> DataFrame:
    """Bars of a symbol in [since, until); only the folders of its months are listed as input."""
    lo, hi = (F.lit(x).cast("timestamp_ntz") for x in (since, until))
    month = F.col("year") * 12 + F.col("month")
    inside = (month >= F.year(lo) * 12 + F.month(lo)) & (month <= F.year(hi) * 12 + F.month(hi))
    return spark.read.parquet(allowed(path)).filter((F.col("symbol") == symbol) & inside & (F.col("ts") >= lo) & (F.col("ts") < hi)).drop("year", "month")


#: Hours from a vendor's clock (EST) to UTC, and what its columns are called here.
EST_HOURS = 5
ASSET_COLUMNS = {"Price": "ts", "Open": "open", "High": "high", "Low": "low", "Close": "close", "Volume": "volume"}


def read_assets(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Files of several assets as exported by a vendor, cleaned: the symbol is the name of a file's folder, which two paths must not share;
    rows whose time is none (such as a second header) are dropped, prices and volumes made numbers, times UTC, and of the rows of one
    time the one of the last file row is kept."""
    folders = [p.rstrip("/").rpartition("/")[2] for p in paths]
    twice = sorted({f for f in folders if folders.count(f) > 1})
    if twice:
        raise DataError(f"two assets would have one name: {twice}")
    raw = spark.read.parquet(*map(allowed, paths))
    names = {k: v for k, v in ASSET_COLUMNS.items() if k in raw.columns}
    missing = sorted(set(ASSET_COLUMNS) - set(names))
    if missing:
        raise DataError(f"missing columns: {missing}")
    number = [F.expr(f"try_cast(`{k}` AS double)").alias(v) for k, v in names.items() if v != "ts"]
    time = (F.expr("try_cast(Price AS timestamp_ntz)") + F.expr(f"INTERVAL {EST_HOURS} HOUR")).alias("ts")
    rows = raw.select(F.element_at(F.split("_metadata.file_path", "/"), -2).alias("symbol"), F.struct("_metadata.file_path", F.monotonically_increasing_id()).alias("_at"), time, *number)
    rest = [v for v in names.values() if v != "ts"]
    return rows.filter(F.col("ts").isNotNull()).groupBy("symbol", "ts").agg(F.max_by(F.struct(*rest), "_at").alias("v")).select("symbol", "ts", "v.*")


def tail(bars: DataFrame, until: Column | None = None, last: int | None = None) -> DataFrame:
    """Bars up to a time, and of each symbol the last so many."""
    got = bars if until is None else bars.filter(F.col("ts") <= until)
    if last is None:
        return got
    return got.withColumn("_k", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("ts")))).filter(F.col("_k") <= last).drop("_k")


def export_csv(spark: SparkSession, bars: DataFrame, path: str) -> str:
    """Write bars in order of symbol and time, and give the digest of what was written: of the files' digests in their order."""
    write_bars_csv(bars.repartitionByRange("symbol", "ts").sortWithinPartitions("symbol", "ts"), path)
    parts = checksums(spark, path).groupBy().agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("name", "sha256"))), lambda x: x["sha256"]), ",").alias("all"))
    return parts.select(F.sha2("all", 256)).first()[0]


def read_calendar(spark: SparkSession, path: str, until: str | None = None) -> DataFrame:
    """An event calendar that passes its gates: all columns there, every time parsed, impacts known, ids unique. Events from `until` on are
    not shown. A failed gate raises with the number of rows that fail it."""
    raw = spark.read.option("header", True).option("inferSchema", False).csv(allowed(path))
    missing = [c for c in CALENDAR if c not in raw.columns]
    if missing:
        raise DataError(f"missing columns: {missing}")
    number = lambda c: (F.expr(f"try_cast(`{c}` AS double)") if c in raw.columns else F.lit(None).cast("double")).alias(c)
    ts = F.expr("try_cast(replace(trim(timestamp_utc), 'Z', '') AS timestamp_ntz)").alias("ts")
    trimmed = [F.trim(c).alias(n) for c, n in (("event_id", "event_id"), ("event_name", "name"), ("country", "country"), ("source", "source"))]
    got = raw.select(ts, *trimmed, F.upper(F.trim("currency")).alias("currency"), F.upper(F.trim("impact")).alias("impact"), *map(number, ("actual", "forecast", "previous", "revision")))
    repeated = got.groupBy("event_id").agg((F.count("*") - 1).alias("more")).agg(F.coalesce(F.sum("more"), F.lit(0)).alias("repeated"))
    gates = got.agg(F.count("*").alias("rows"), F.count_if(F.col("ts").isNull()).alias("untimed"), F.count_if(~F.coalesce(F.col("impact").isin(*IMPACTS), F.lit(False))).alias("impacts")).join(repeated, F.lit(True)).first()
    if not gates["rows"] or gates["untimed"] or gates["impacts"] or gates["repeated"]:
        raise DataError(f"the calendar fails its gates: {gates.asDict()}")
    got = got.withColumn("surprise", F.col("actual") - F.col("forecast"))
    return got if until is None else got.filter(F.col("ts") < F.lit(until).cast("timestamp_ntz"))


def read_registry(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; lines that are no records are left out."""
    got = spark.read.schema(f"{schema}, _bad string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(allowed(path))
    return got.filter(F.col("_bad").isNull()).drop("_bad")


def append(spark: SparkSession, path: str, new: DataFrame, key: str, content: str) -> int:
    """Append records to a store of Parquet files, whose committer shows all of a write or nothing. Known records are left out; one whose
    content changed refuses the whole batch. Gives the number appended."""
    plan = append_plan(spark.read.parquet(allowed(path)), new, key, content)
    counts = {r["action"]: r["count"] for r in plan.groupBy("action").count().collect()}  # three actions
    if counts.get("conflict"):
        raise DataError(f"{counts['conflict']} records have other content than the store's")
    if counts.get("append"):
        plan.filter("action = 'append'").drop("action").write.mode("append").parquet(path)
    return counts.get("append", 0)
