"""Chains of rows that each point at a later one, followed by doubling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import asof


def cut_lineage(df: DataFrame) -> DataFrame:
    """A checkpoint in the folder that all executors share; only a local session may do without naming one."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_top(df.sparkSession))
    return df.checkpoint(eager=True)


def shared_top(spark: SparkSession) -> str:
    sc = spark.sparkContext
    top = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir")
    if not top and not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return top or "/tmp/checkpoints/lodemark"


def spaced(rows: DataFrame, by: str, ts: str, key: str, seconds: int) -> DataFrame:
    """(by, key) of the rows that a greedy pass keeps: the first, then always the first at least `seconds` after the last kept.
    Ties of time go by key, which is unique. Each round doubles the part of every chain that is marked."""
    at = rows.groupBy(F.col(by).alias("_by"), F.col(ts).alias("ts")).agg(F.min(key).alias("_to"))
    probes = rows.select(F.col(by).alias("_by"), F.col(key).alias("_key"), (F.col(ts) + F.make_dt_interval(secs=F.lit(seconds))).alias("_t"))
    jump = asof.forward(probes, at, ["_to"], by="_by", at="_t").filter(F.col("_to").isNotNull())
    jump = cut_lineage(jump.select("_by", F.col("_key").alias("_from"), "_to"))
    marked = cut_lineage(rows.groupBy(F.col(by).alias("_by")).agg(F.min_by(key, F.struct(ts, key)).alias("_key")))
    while not jump.isEmpty():
        ahead = marked.join(jump.withColumnRenamed("_from", "_key"), ["_by", "_key"]).select("_by", F.col("_to").alias("_key"))
        marked = cut_lineage(marked.unionByName(ahead).distinct())
        further = jump.select("_by", F.col("_from").alias("_to"), F.col("_to").alias("_next"))
        jump = cut_lineage(jump.join(further, ["_by", "_to"]).select("_by", "_from", F.col("_next").alias("_to")))
    return marked.select(F.col("_by").alias(by), F.col("_key").alias(key))
