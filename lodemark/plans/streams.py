"""Queries run as streams over the files of the events table, against the same windows in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import bars as SB
from .base import TICKS
from .registry import query

_OHLC = "first(price ORDER BY ts, seq) AS open, max(price) AS high, min(price) AS low, last(price ORDER BY ts, seq) AS close, count(*) AS n"


@query(384, 385, sql=f"WITH {TICKS} SELECT symbol, time_bucket(INTERVAL 4 HOUR, ts) AS start, time_bucket(INTERVAL 4 HOUR, ts) + INTERVAL 4 HOUR AS end, {_OHLC} FROM ticks GROUP BY 1, 2, 3")
def streaming_bars(spark, sf_dir):
    """Tumbling four-hour bars."""
    return SB.finished(spark, SB.windowed(SB.ticks(spark, sf_dir), F.window("ts", "4 hours")))


@query(386, sql=f"""WITH {TICKS}, s AS (SELECT *, unnest([time_bucket(INTERVAL 1 HOUR, ts), time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 1 HOUR]) AS start FROM ticks)
SELECT symbol, start, start + INTERVAL 2 HOUR AS end, {_OHLC} FROM s GROUP BY 1, 2""")
def streaming_sliding_bars(spark, sf_dir):
    """Two-hour bars that begin every hour."""
    return SB.finished(spark, SB.windowed(SB.ticks(spark, sf_dir), F.window("ts", "2 hours", "1 hour")))


#: Bars that the store of closed bars keeps of a symbol.
KEPT = 48


@query(36, 385, sql=f"""WITH {TICKS}, b AS (SELECT symbol, date_trunc('hour', ts) AS start, {_OHLC} FROM ticks GROUP BY 1, 2), m AS (SELECT max(ts) - INTERVAL 2 HOUR AS mark FROM ticks),
c AS (SELECT b.*, row_number() OVER (PARTITION BY symbol ORDER BY start DESC) AS k FROM b, m WHERE start + INTERVAL 1 HOUR <= mark)
SELECT symbol, count(*) OVER (PARTITION BY symbol) AS held, start AS ts, open, high, low, close, n FROM c WHERE k <= {KEPT}""")
def closed_bar_store(spark, sf_dir):
    """Keyed state of fixed length: what it holds of each symbol once the stream has seen all files."""
    return SB.closed_bars(spark, sf_dir, KEPT)
