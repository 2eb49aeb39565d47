"""Rolling columns over a series. Every function takes the series window w (partition and order).

A rolling value is null until its frame is full, and null if the frame holds a
null, as the research series define it; all are causal unless said otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


def series(*partition: str, order: str = "ts") -> WindowSpec:
    return Window.partitionBy(*partition).orderBy(order)


def full(x: Column, value: Column, w: WindowSpec, n: int, upto: int = 0) -> Column:
    """value where all n rows of the frame ending at upto have x."""
    return F.when(F.count(x).over(w.rowsBetween(upto - n + 1, upto)) == n, value)


def sma(x: Column, n: int, w: WindowSpec) -> Column:
    return full(x, F.avg(x).over(w.rowsBetween(1 - n, 0)), w, n)


def wma(x: Column, n: int, w: WindowSpec) -> Column:
    total = sum((F.lag(x, i).over(w) if i else x) * (n - i) for i in range(n))
    return full(x, total / (n * (n + 1) / 2), w, n)


def rolling_std(x: Column, n: int, w: WindowSpec, sample: bool = False, upto: int = 0) -> Column:
    std = F.stddev_samp if sample else F.stddev_pop
    return full(x, std(x).over(w.rowsBetween(upto - n + 1, upto)), w, n, upto)


def bollinger(x: Column, n: int, k: float, w: WindowSpec) -> tuple[Column, Column, Column]:
    mid, dev = sma(x, n, w), k * rolling_std(x, n, w)
    return mid - dev, mid, mid + dev


def true_range(high: Column, low: Column, close: Column, w: WindowSpec) -> Column:
    """The first row has no previous close; greatest skips nulls, so it is high - low."""
    before = F.lag(close).over(w)
    return F.greatest(high - low, F.abs(high - before), F.abs(low - before))


def roc(x: Column, n: int, w: WindowSpec) -> Column:
    return 100 * (F.try_divide(x, F.lag(x, n).over(w)) - 1)


def momentum(x: Column, n: int, w: WindowSpec) -> Column:
    return x - F.lag(x, n).over(w)


def relative_momentum(x: Column, n: int, w: WindowSpec) -> Column:
    return F.try_divide(momentum(x, n, w), F.lag(x, n).over(w))


def donchian(high: Column, low: Column, n: int, w: WindowSpec, upto: int = 0) -> tuple[Column, Column]:
    frame = w.rowsBetween(upto - n + 1, upto)
    return full(high, F.max(high).over(frame), w, n, upto), full(low, F.min(low).over(frame), w, n, upto)


def midpoint(high: Column, low: Column, n: int, w: WindowSpec) -> Column:
    top, bottom = donchian(high, low, n, w)
    return (top + bottom) / 2


def aroon(high: Column, low: Column, n: int, w: WindowSpec) -> tuple[Column, Column]:
    """100 * position of the first extreme in n + 1 rows / n."""
    frame = w.rowsBetween(-n, 0)
    at = lambda x, pick: F.array_position(F.collect_list(x).over(frame), pick(x).over(frame)) - 1
    return full(high, 100.0 * at(high, F.max) / n, w, n + 1), full(low, 100.0 * at(low, F.min) / n, w, n + 1)


def zscore(x: Column, n: int, w: WindowSpec) -> Column:
    return F.try_divide(x - sma(x, n, w), F.nullif(rolling_std(x, n, w), F.lit(0.0)))


def log_return(x: Column, w: WindowSpec) -> Column:
    return F.ln(F.try_divide(x, F.lag(x).over(w)))


def obv(close: Column, volume: Column, w: WindowSpec) -> Column:
    sign = F.coalesce(F.signum(close - F.lag(close).over(w)), F.lit(0.0))
    return sign * F.coalesce(volume, F.lit(0.0))


def hold(signal: Column, w: WindowSpec) -> Column:
    """The last signal that is not 0, else 0."""
    return F.coalesce(F.last(F.nullif(signal, F.lit(0)), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))


def limited_fill(x: Column, limit: int, w: WindowSpec) -> Column:
    return F.last(x, ignorenulls=True).over(w.rowsBetween(-limit, 0))


def crossed_above(x: Column, level: Column | float, w: WindowSpec) -> Column:
    """Previous value under the level and this one at or over it; 0 where either is missing."""
    return F.when((F.lag(x).over(w) < level) & (x >= level), 1).otherwise(0)


def crossover(fast: Column, slow: Column, w: WindowSpec) -> Column:
    return F.when((fast > slow) & (F.lag(fast).over(w) <= F.lag(slow).over(w)), 1).otherwise(0)


def run_length(sign: Column, w: WindowSpec, partition: list[str]) -> tuple[Column, Column]:
    """Gaps and islands: the id of the run a row is in, and its place in it (both over helper windows)."""
    change = F.when(sign.eqNullSafe(F.lag(sign).over(w)), 0).otherwise(1)
    return change, F.sum(change).over(w.rowsBetween(Window.unboundedPreceding, 0))
