"""Walk-forward selection from prefix sums.

The returns of every configuration are reduced once to running sums of 1, x and
x^2 on position; each fold then takes two look-ups a configuration and slice,
however many folds there are or however long they are, by one equi-join. What
a fold selects depends on its train slice alone, which ends `horizon` rows
before the test slice, as a return looks that far ahead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def windows(lengths: DataFrame, n: str, train: int, test: int, step: int, inclusive: bool = True) -> DataFrame:
    """Adds fold, start, train_end and test_end to each series' row. inclusive: whether a window may end where the series does."""
    last = F.col(n) - train - test - (0 if inclusive else 1)
    got = lengths.withColumn("start", F.explode(F.when(last >= 0, F.sequence(F.lit(0), last.cast("int"), F.lit(step))).otherwise(F.array().cast("array<int>"))))
    s = F.col("start")
    return got.withColumns({"fold": (s / step + 1).cast("int"), "train_end": s + train, "test_end": s + train + test})


def running(returns: DataFrame, by: list[str], pos: str, x: str) -> DataFrame:
    """(by, pos, n, s, q): sums over all rows up to pos; rows without x keep the sums."""
    w = Window.partitionBy(*by).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    c = F.col(x)
    return returns.select(*by, pos, F.count(c).over(w).alias("n"), F.coalesce(F.sum(c).over(w), F.lit(0.0)).alias("s"), F.coalesce(F.sum(c * c).over(w), F.lit(0.0)).alias("q"))


def sharpe(n: Column, s: Column, q: Column) -> Column:
    """Mean over sample deviation of the rows summed; 0 where it is not defined."""
    var = (q - s * s / n) / (n - 1)
    return F.round(F.when((n > 1) & (var > 1e-18), s / n / F.sqrt(var)).otherwise(0.0), 9)


def scored(returns: DataFrame, folds: DataFrame, by: str, config: str, pos: str, x: str, horizon: int = 1) -> DataFrame:
    """Every fold and configuration with train_n, train_sr, test_n, test_sr and test_sum."""
    sums = running(returns, [by, config], pos, x).select(F.col(by).alias("_by"), config, F.col(pos).alias("_pos"), "n", "s", "q")
    edges = {"a": F.col("start"), "b": F.col("train_end") - horizon, "c": F.col("train_end"), "d": F.col("test_end") - horizon}
    cut = folds.select(by, "fold", "start", "train_end", "test_end", F.explode(F.array(*[F.struct(F.lit(k).alias("edge"), (v - 1).alias("at")) for k, v in edges.items()])).alias("e"))
    met = cut.join(sums, (F.col(by) == F.col("_by")) & (F.col("e.at") == F.col("_pos")))  # the edge before the first row meets none
    at = lambda k, v: F.coalesce(F.max(F.when(F.col("e.edge") == k, F.col(v))), F.lit(0))  # noqa: E731  one row an edge
    got = met.groupBy(by, "fold", "start", "train_end", "test_end", config).agg(*[(at(hi, v) - at(lo, v)).alias(f"{part}_{v}") for part, lo, hi in (("train", "a", "b"), ("test", "c", "d")) for v in "nsq"])
    ratio = lambda part: sharpe(*[F.col(f"{part}_{v}") for v in "nsq"]).alias(f"{part}_sr")
    return got.select(by, "fold", "start", "train_end", "test_end", config, "train_n", ratio("train"), "test_n", ratio("test"), F.round("test_s", 9).alias("test_sum"))


def best(scores: DataFrame, by: str, config: str, least: int = 3) -> DataFrame:
    """Of each fold the configuration of highest train Sharpe with at least `least` trades, ties to the lesser; folds without any have no row."""
    rest = [c for c in scores.columns if c not in (by, "fold", "start", "train_end", "test_end")]
    fit = scores.filter(F.col("train_n") >= least)
    return fit.groupBy(by, "fold", "start", "train_end", "test_end").agg(F.max_by(F.struct(*rest), F.struct("train_sr", -F.col(config))).alias("v")).select(by, "fold", "start", "train_end", "test_end", "v.*")


def report(chosen: DataFrame, by: str) -> DataFrame:
    """Of each series: folds, mean Sharpe of both slices, efficiency, consistency and test trades."""
    level = F.avg(F.abs("train_sr"))
    return chosen.groupBy(by).agg(
        F.count("*").alias("folds"), F.round(F.avg("train_sr"), 6).alias("mean_train"), F.round(F.avg("test_sr"), 6).alias("mean_test"),
        F.round(F.when(level > 1e-9, F.avg("test_sr") / level).otherwise(0.0), 6).alias("efficiency"), F.round(F.avg((F.col("test_sr") > 0).cast("int")), 6).alias("consistency"),
        F.sum("test_n").alias("test_trades"),
    )
