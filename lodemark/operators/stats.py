"""Trade and equity statistics as aggregates; undefined values are null unless a sentinel is part of the result.

Sums and moments combine on the map side. Only order-dependent figures
(drawdown, streaks) need a running window, which callers partition by strategy
or account and pre-aggregate to a day's result where a key may be hot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

#: Stands for a profit factor or Sortino without losses.
NO_LOSS = 999.0


def t_stat(x: Column) -> Column:
    """mean / sqrt(sample variance / n)."""
    return F.try_divide(F.avg(x), F.nullif(F.stddev_samp(x), F.lit(0.0)) / F.sqrt(F.count(x)))


def profit_factor(x: Column) -> Column:
    gains, losses = F.sum(F.when(x > 0, x)), F.abs(F.sum(F.when(x < 0, x)))
    return F.when(losses.isNull() | (losses == 0), NO_LOSS).otherwise(F.coalesce(gains, F.lit(0.0)) / losses)


def win_rate(x: Column) -> Column:
    return F.avg((x > 0).cast("int"))


def upper_median(x: Column) -> Column:
    """sorted[n // 2], an element and never a mean of two."""
    return F.get(F.sort_array(F.collect_list(x)), F.floor(F.count(x) / 2).cast("int"))


def trade_stats(trades: DataFrame, by: list[str], x: str = "pnl", more: tuple[Column, ...] = ()) -> DataFrame:
    """Statistics of x in each group, and further aggregates from the same pass."""
    c = F.col(x)
    return trades.groupBy(*by).agg(
        F.count(c).alias("n"), F.round(F.avg(c), 6).alias("mean"), F.round(t_stat(c), 3).alias("t"), F.round(profit_factor(c), 3).alias("pf"),
        F.round(win_rate(c), 4).alias("win_rate"), F.round(F.sum(c), 4).alias("total"), *more,
    )


def skewness(x: Column) -> Column:
    """Bias-corrected (G1)."""
    n = F.count(x)
    return F.when(n > 2, F.skewness(x) * F.sqrt(n * (n - 1)) / (n - 2))


def kurtosis(x: Column) -> Column:
    """Bias-corrected excess (G2)."""
    n = F.count(x)
    return F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(x) + 6))


def sharpe(x: Column, per_year: float) -> Column:
    dev = F.stddev_samp(x)
    return F.when((F.count(x) >= 2) & (dev > 1e-12), F.avg(x) / dev * F.sqrt(F.lit(per_year))).otherwise(0.0)


def sortino(x: Column, per_year: float, target: float = 0.0) -> Column:
    """Root mean square shortfall of the rows below the target only."""
    down = F.sqrt(F.avg(F.when(x < target, (x - target) * (x - target))))
    return F.when(down > 1e-12, (F.avg(x) - target) / down * F.sqrt(F.lit(per_year))).otherwise(0.0)


def value_at_risk(x: Column, confidence: float = 0.95) -> Column:
    return F.when(F.count(x) >= 5, F.abs(F.least(F.percentile(x, 1 - confidence), F.lit(0.0))))


def tail_ratio(x: Column) -> Column:
    return F.when(F.count(x) >= 20, F.try_divide(F.percentile(x, 0.95), F.abs(F.percentile(x, 0.05))))


def drawdowns(curve: DataFrame, w: WindowSpec, value: str = "equity") -> DataFrame:
    """Adds peak, dd (fraction below it, null at a peak of 0) and dd_abs."""
    peak = F.max(value).over(w.rowsBetween(Window.unboundedPreceding, 0))
    got = curve.withColumn("peak", peak)
    return got.withColumn("dd", F.try_divide(F.col("peak") - F.col(value), F.nullif("peak", F.lit(0.0)))).withColumn("dd_abs", F.col("peak") - F.col(value))


def islands(df: DataFrame, flag: Column, by: list[str], order: list[str]) -> DataFrame:
    """(by, run, value, length) of maximal runs of equal flag values."""
    w = Window.partitionBy(*by).orderBy(*order)
    got = df.withColumn("value", flag).withColumn("_start", F.when(F.col("value").eqNullSafe(F.lag("value").over(w)), 0).otherwise(1))
    got = got.withColumn("run", F.sum("_start").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return got.groupBy(*by, "run").agg(F.first("value").alias("value"), F.count("*").alias("length"))
