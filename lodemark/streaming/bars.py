"""Bars of a stream of ticks: tumbling, sliding and session windows over event time with a watermark, and a store of the last closed ones.

Ticks are read as files arrive, files_per_trigger of them a batch; without that
number all files there are form one batch, in which nothing is late. The
watermark follows the latest tick of the batches before: a repeated tick is
dropped while the watermark still covers it, and a tick older than the
watermark is dropped and counted. Windows are written as they change, with
their batch, so that a batch run again after a failure replaces its own files;
the last version of a window is its value. A stream that is started again on
its state folder goes on where it stopped.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.chains import cut_lineage
from ..sources import files

LATE = "2 hours"
#: The keyed state of the bar store needs it.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def ticks(spark: SparkSession, sf_dir: str, late: str = LATE, files_per_trigger: int | None = None) -> DataFrame:
    """The stream of ticks, each once, without those later than the watermark."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    raw = reader.parquet(f"{sf_dir}/events.parquet*")
    rows = raw.select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), F.col("value").alias("price"))
    return rows.withWatermark("ts", late).dropDuplicatesWithinWatermark(["seq"])


def windowed(rows: DataFrame, window: Column, by: str = "symbol") -> DataFrame:
    """(by, w, open, high, low, close, n) of each window; open and close follow time, then arrival."""
    order = F.struct("ts", "seq")
    return rows.groupBy(by, window.alias("w")).agg(
        F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"), F.count("*").alias("n")
    )


def run(stream: DataFrame, out: str, state: str, mode: str = "update") -> int:
    """Process what files there are and stop; batches go to folders below out. Gives the number of ticks dropped as too late."""

    def save(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/{number}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", state).foreachBatch(save).trigger(availableNow=True).start()
    query.awaitTermination()
    return sum(op["numRowsDroppedByWatermark"] for batch in query.recentProgress for op in batch["stateOperators"])


def windows_of(spark: SparkSession, out: str, by: list[str]) -> DataFrame:
    """The last version of each window that run() has written below out."""
    rows = spark.read.option("recursiveFileLookup", True).parquet(out)
    rest = [c for c in rows.columns if c not in (*by, "w", "batch")]
    last = rows.groupBy(*by, F.col("w.start").alias("start"), F.col("w.end").alias("end")).agg(F.max_by(F.struct(*rest), "batch").alias("v"))
    return last.select(*by, F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "v.*")


def finished(spark: SparkSession, bars: DataFrame, mode: str = "update") -> DataFrame:
    """Run over all files there are, and give the last version of each window. Update mode shows every window, also those that the
    watermark has not closed; sessions, which may merge, are shown by append mode once they are closed."""
    out, state = files.new_folder(spark, "stream-bars"), files.new_folder(spark, "stream-state")
    run(bars, out, state, mode)
    got = cut_lineage(windows_of(spark, out, [c for c in ("symbol", "user_id") if c in bars.columns]))
    for path in (out, state):
        files.delete(spark, path)
    return got


BAR = "ts timestamp, open double, high double, low double, close double, n long"
_FIELDS = [x.split()[0] for x in BAR.split(", ")]


class BarStore(StatefulProcessor):
    """The last `length` bars of a symbol as list state: a bar of a known time replaces it, others find their place by time."""

    def __init__(self, length: int):
        self.length = length

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.bars = handle.getListState("bars", BAR)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        held = {bar[0]: tuple(bar) for bar in self.bars.get()} if self.bars.exists() else {}
        for frame in rows:
            for bar in frame.sort_values("arrival")[_FIELDS].itertuples(index=False):
                held[bar.ts.to_pydatetime()] = (bar.ts.to_pydatetime(), *map(float, bar[1:5]), int(bar.n))
        kept = [held[t] for t in sorted(held)[-self.length :]]
        self.bars.put(kept)
        frame = pd.DataFrame(kept, columns=_FIELDS)
        yield frame.assign(symbol=key[0], held=len(kept))[["symbol", "held", *_FIELDS]]

    def close(self) -> None:
        pass


def stored(bars: DataFrame, length: int) -> DataFrame:
    """The content of the store after each batch that changes it. bars: symbol, arrival (which of two bars of a time is the later), BAR."""
    bars.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    return bars.groupBy("symbol").transformWithStateInPandas(BarStore(length), f"symbol string, held long, {BAR}", "Append", "None")


def last_stored(spark: SparkSession, out: str) -> DataFrame:
    """Of each symbol what the store held after its last batch."""
    rows = spark.read.option("recursiveFileLookup", True).parquet(out)
    newest = rows.groupBy("symbol").agg(F.max("batch").alias("batch"))
    return rows.join(newest, ["symbol", "batch"]).drop("batch")


def closed_bars(spark: SparkSession, sf_dir: str, length: int, width: str = "1 hour", late: str = LATE) -> DataFrame:
    """The last `length` bars of each symbol that the watermark has closed. Ticks are reduced to bars before a symbol's state sees them."""
    out, state = files.new_folder(spark, "stream-store"), files.new_folder(spark, "stream-state")
    bars = windowed(ticks(spark, sf_dir, late), F.window("ts", width))
    bars = bars.select("symbol", F.col("w.end").alias("arrival"), F.col("w.start").alias("ts"), "open", "high", "low", "close", "n")
    run(stored(bars, length), out, state, "append")
    got = cut_lineage(last_stored(spark, out).withColumn("ts", F.col("ts").cast("timestamp_ntz")))
    for path in (out, state):
        files.delete(spark, path)
    return got
