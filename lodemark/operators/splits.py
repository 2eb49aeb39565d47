"""Chronological partitions, walk-forward windows and block combinations."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def chronological(df: DataFrame, by: str, order: list[str], shares: tuple[float, float]) -> DataFrame:
    """Adds part: train, validation, holdout by position; cuts are floor(n * share)."""
    w = Window.partitionBy(by).orderBy(*order)
    got = df.withColumn("_r", F.row_number().over(w)).withColumn("_n", F.count("*").over(Window.partitionBy(by)))
    first = F.floor(F.col("_n") * shares[0])
    part = F.when(F.col("_r") <= first, "train").when(F.col("_r") <= first + F.floor(F.col("_n") * shares[1]), "validation").otherwise("holdout")
    return got.withColumn("part", part).drop("_n")


def sealed(df: DataFrame, by: str, key: str, ts: str) -> DataFrame:
    """Bounds and an order-sensitive digest of each part's keys."""
    ids = F.transform(F.array_sort(F.collect_list(F.struct("_r", key))), lambda x: x[key].cast("string"))
    return df.groupBy(by, "part").agg(F.count("*").alias("n"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.md5(F.array_join(ids, ",").cast("binary")).alias("seal"))


def walk_forward(spark: SparkSession, n: int, train: int, test: int, step: int) -> DataFrame:
    """Window bounds; the range of starts ends before n - train - test, which is left out."""
    starts = F.explode(F.sequence(F.lit(0), F.lit(n - train - test - 1), F.lit(step))) if n > train + test else F.explode(F.array().cast("array<int>"))
    s = F.col("start")
    return spark.range(1).select(starts.alias("start")).select("start", (s + train).alias("train_end"), (s + train).alias("test_start"), (s + train + test).alias("test_end"))


def block_choices(spark: SparkSession, blocks: int) -> DataFrame:
    """(combo, in_sample): all choices of half the blocks, a small table."""
    rows = [(i, list(c)) for i, c in enumerate(combinations(range(blocks), blocks // 2))]
    return spark.createDataFrame(rows, "combo int, in_sample array<int>")


def overfitting(returns: DataFrame, config: str, order: list[str], x: str, blocks: int = 8) -> DataFrame:
    """PBO by combinatorially symmetric cross-validation. Sharpe ratios of a choice of blocks follow from block sums of 1, x and x^2,
    so the returns are reduced once and only (config, block) rows meet the choices."""
    spark = returns.sparkSession
    w = Window.partitionBy(config).orderBy(*order)
    r = returns.withColumn("_i", F.row_number().over(w) - 1).withColumn("_n", F.count("*").over(Window.partitionBy(config)))
    size = F.floor(F.col("_n") / blocks)
    r = r.withColumn("block", F.floor(F.try_divide(F.col("_i"), size)).cast("int")).filter(F.col("block") < blocks)  # shorter series have no block
    sums = r.groupBy(config, "block").agg(F.count(x).alias("n"), F.sum(x).alias("s"), F.sum(F.col(x) * F.col(x)).alias("q"))
    c = block_choices(spark, blocks).join(sums, F.lit(True)).withColumn("inside", F.array_contains("in_sample", F.col("block")))
    part = lambda cond, v: F.sum(F.when(cond, F.col(v)).otherwise(0))
    ins, out = F.col("inside"), ~F.col("inside")
    g = c.groupBy("combo", config).agg(*[part(k, v).alias(f"{v}{i}") for i, k in (("i", ins), ("o", out)) for v in ("n", "s", "q")])

    def ratio(i: str):
        n, s, q = F.col(f"n{i}"), F.col(f"s{i}"), F.col(f"q{i}")
        var = (q - s * s / n) / (n - 1)
        return F.when(var > 1e-24, s / n / F.sqrt(var)).otherwise(0.0)

    g = g.select("combo", config, F.round(ratio("i"), 12).alias("is_sr"), F.round(ratio("o"), 12).alias("oos_sr"))
    by = Window.partitionBy("combo")
    g = g.withColumn("rank", F.row_number().over(by.orderBy("oos_sr", config))).withColumn("m", F.count("*").over(by)).withColumn("best", F.row_number().over(by.orderBy(F.desc("is_sr"), config)))
    u = F.col("rank") / (F.col("m") + 1)
    g = g.filter("best = 1").withColumn("logit", F.ln(u / (1 - u)))
    return g.agg(F.count("*").alias("combos"), F.round(F.avg((F.col("logit") <= 0).cast("int")), 6).alias("pbo"), F.round(F.avg("logit"), 6).alias("mean_logit"))
