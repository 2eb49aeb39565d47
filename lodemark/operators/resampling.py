"""Bootstraps of any statistic.

A group's values are one array (results of days, which the calendar bounds),
each resample picks from it by hashes of seed, group, resample and place, so a
resample is the same on every run and partitioning, and an Arrow function
applies the caller's statistic to a batch of resamples. Nothing is shuffled
after the arrays are made.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .draws import hashed


def resampled(values: DataFrame, by: str, order: str, x: str, resamples: int, seed: str) -> DataFrame:
    """(by, it, sample): samples as long as the group, with replacement."""
    arrays = values.filter(F.col(x).isNotNull()).groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, x))), lambda v: v[x]).alias("_all"))
    each = arrays.withColumn("it", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))))
    place = lambda i: F.pmod(hashed(F.lit(seed), F.col(by), F.col("it"), i), F.size("_all")).cast("int")
    return each.select(by, "it", F.transform(F.sequence(F.lit(0), F.size("_all") - 1), lambda i: F.get("_all", place(i))).alias("sample"))


def statistic(f: Callable[[np.ndarray], float], sample: str = "sample"):
    """A column of f of every sample; f gets the values as doubles and gives a number. Not a number becomes null."""

    @F.pandas_udf("double")
    def run(samples: pd.Series) -> pd.Series:
        return pd.Series([float(f(np.asarray(s, dtype="f8"))) for s in samples], dtype="float64")

    got = run(F.col(sample))
    return F.when(~F.isnan(got), got)


def bootstrap(values: DataFrame, by: str, order: str, x: str, f: Callable[[np.ndarray], float], resamples: int = 1000, seed: str = "7", level: float = 0.95) -> DataFrame:
    """Of each group the interval of f over all resamples, the share above 0, and whether that is at least the level."""
    got = resampled(values, by, order, x, resamples, seed).select(by, statistic(f).alias("v"))
    share = F.avg((F.col("v") > 0).cast("int"))
    edge = lambda p, name: F.percentile("v", p).alias(name)  # noqa: E731  over the resamples, whose number is stated
    return got.groupBy(by).agg(F.count("v").alias("resamples"), edge((1 - level) / 2, "low"), edge(0.5, "mid"), edge((1 + level) / 2, "high"), F.round(share, 6).alias("positive"), (share >= level).alias("survives"))


def perturbed(parameters: DataFrame, names: list[str], times: int = 16, spread: float = 0.1, seed: str = "7") -> DataFrame:
    """Every row `times` times with its named parameters moved by up to `spread` of themselves either way, by hash; adds it (0 is unmoved)."""
    each = parameters.withColumn("it", F.explode(F.sequence(F.lit(0), F.lit(times))))
    move = lambda c: F.when(F.col("it") == 0, F.col(c)).otherwise(F.col(c) * (1 + spread * (hashed(F.lit(seed), F.lit(c), F.col(c), F.col("it")) / 2147483648 - 1)))
    return each.withColumns({c: move(c) for c in names})
