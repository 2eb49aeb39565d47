"""Tables and the market views derived from them.

Ticks are events: the event type is the symbol, the value the price, the event
id the arrival order, and ``k`` of the JSON properties the volume. Bars are
aggregated with map-side combine, so ticks of a busy symbol never gather in one
task; what runs over whole series per symbol afterwards is bars, whose number
is bounded by the calendar.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.regexp_extract("props", r'"k": (-?[0-9]+)', 1)
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("symbol"), "ts", F.col("event_id").alias("seq"), F.col("value").alias("price"),
        F.when(k != "", k.cast("double")).alias("volume"), "user_id",
    )


def ohlcv(order: Column | None = None) -> list[Column]:
    """Aggregates of a bar; open and close follow time, then arrival."""
    order = F.struct("ts", "seq") if order is None else order
    return [
        F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
        F.max_by("price", order).alias("close"), F.sum("volume").alias("volume"), F.count("*").alias("n"),
    ]


def hour_of(ts: Column) -> Column:
    return F.date_trunc("hour", ts).cast("timestamp_ntz")


def bars_1h(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ticks(spark, sf_dir).groupBy("symbol", hour_of(F.col("ts")).alias("hour")).agg(*ohlcv()).withColumnRenamed("hour", "ts")


def bars_1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ticks(spark, sf_dir).groupBy("symbol", F.to_date("ts").alias("date")).agg(*ohlcv(), F.max("ts").alias("last_ts"))


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trade-like rows: a signed result per order line, with group keys and a total order (seq)."""
    line, order = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    pnl = (F.col("l_extendedprice") * (F.lit(0.05) - F.col("l_discount"))).alias("pnl")
    return line.join(order, line["l_orderkey"] == order["o_orderkey"]).select(
        F.col("l_returnflag").alias("strategy"), F.col("o_orderpriority").alias("regime"), F.col("l_shipdate").alias("exit_ts"),
        F.col("o_orderdate").alias("entry_ts"), F.col("l_orderkey").alias("orderkey"), F.col("l_linenumber").alias("line"), pnl,
        F.col("l_extendedprice").alias("notional"), (F.col("l_tax") * F.col("l_extendedprice") / 100).alias("cost"), F.col("l_quantity").alias("volume"),
        F.datediff("l_shipdate", "o_orderdate").alias("hold_days"),
    )
