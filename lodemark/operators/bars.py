"""Bars: cleaning, tails, right-closed buckets and two-pass indicators."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions import rolling as R
from ..sources.tables import ohlcv

PRICES = ("open", "high", "low", "close")


def normalise(raw: DataFrame, seq: str = "seq") -> DataFrame:
    """Canonical bars: parsed UTC time, doubles, volume 0 where missing, the last arrival of (symbol, ts), no null price.
    Arrival is an explicit column, as rows of a cluster have no order of their own."""
    names = {c.lower().strip(): c for c in raw.columns}
    number = lambda c: F.expr(f"try_cast(`{names[c]}` AS double)")
    got = raw.select(
        F.col(names["symbol"]).alias("symbol"), F.expr(f"try_cast(`{names['ts']}` AS timestamp_ntz)").alias("ts"),
        *[F.nanvl(number(c), F.lit(None).cast("double")).alias(c) for c in PRICES],
        (F.coalesce(number("volume"), F.lit(0.0)) if "volume" in names else F.lit(0.0)).alias("volume"), F.col(names[seq]).alias("_seq"),
    )
    got = got.filter(F.col("ts").isNotNull())
    last = got.groupBy("symbol", "ts").agg(F.max_by(F.struct(*PRICES, "volume"), "_seq").alias("b"))
    return last.select("symbol", "ts", "b.*").dropna(subset=list(PRICES))


def tail(bars: DataFrame, n: int) -> DataFrame:
    """The last n bars of each symbol."""
    w = Window.partitionBy("symbol").orderBy(F.desc("ts"))
    return bars.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= n).drop("_k")


def resample_right(ticks: DataFrame, seconds: int) -> DataFrame:
    """Buckets (t - size, t] labelled t; empty ones do not appear."""
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    label = F.timestamp_seconds(F.ceil(micros / (seconds * 1_000_000)) * seconds).cast("timestamp_ntz").alias("label")
    return ticks.groupBy("symbol", label).agg(*ohlcv())


def stochastic_cci(bars: DataFrame, w: WindowSpec, n: int = 14, smooth: int = 3, cci: int = 20) -> DataFrame:
    """Adds k, d and cci; each stage's null keeps the next stage's frame from being full."""
    h, low, c = F.col("high"), F.col("low"), F.col("close")
    top, bottom = R.donchian(h, low, n, w)
    got = bars.withColumn("raw", 100 * F.try_divide(c - bottom, F.nullif(top - bottom, F.lit(0.0)))).withColumn("tp", (h + low + c) / 3)
    got = got.withColumn("k", R.sma(F.col("raw"), smooth, w)).withColumn("mean", R.sma(F.col("tp"), cci, w))
    got = got.withColumn("d", R.sma(F.col("k"), smooth, w)).withColumn("dev", F.abs(F.col("tp") - F.col("mean")))
    return got.withColumn("cci", F.try_divide(F.col("tp") - F.col("mean"), F.nullif(0.015 * R.sma(F.col("dev"), cci, w), F.lit(0.0))))
