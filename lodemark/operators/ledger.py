"""Append-only records: latest versions, idempotent appends, similar records, legal transitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """The last version of each key, by aggregation (a hot key combines on the map side)."""
    rest = [c for c in df.columns if c not in by]
    return df.groupBy(*by).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_v")).select(*by, "_v.*")


def append_plan(store: DataFrame, new: DataFrame, key: str, content: str) -> DataFrame:
    """New rows with an action: append, no_op (same content) or conflict (the caller must refuse the batch)."""
    old = store.select(F.col(key).alias("_k"), F.col(content).alias("_c"))
    got = new.join(old, F.col(key) == F.col("_k"), "left")
    action = F.when(F.col("_k").isNull(), "append").when(F.col("_c") == F.col(content), "no_op").otherwise("conflict")
    return got.withColumn("action", action).drop("_k", "_c")


def token_pairs(items: DataFrame, key: str, tokens: str) -> DataFrame:
    """(a, b, sim) of ordered pairs of items that share a token. For a stated, bounded set of items."""
    t = items.select(F.col(key).alias("a"), F.size(tokens).alias("na"), F.explode(tokens).alias("t"))
    o = t.select(F.col("a").alias("b"), F.col("na").alias("nb"), "t")
    both = t.join(o, "t").filter("a <> b").groupBy("a", "b", "na", "nb").agg(F.count("*").alias("k"))
    return both.select("a", "b", (F.col("k") / (F.col("na") + F.col("nb") - F.col("k"))).alias("sim"))


def nearest_by_tokens(items: DataFrame, key: str, tokens: str) -> DataFrame:
    from ..functions.text import similarity_class

    best = token_pairs(items, key, tokens).groupBy("a").agg(F.max("sim").alias("s"), F.max_by("b", F.struct("sim", -F.col("b"))).alias("nearest"))
    return best.select("a", F.round("s", 6).alias("best"), "nearest", similarity_class(F.col("s")).alias("class"))


def illegal_transitions(df: DataFrame, key: str, order: list[str], state: str, legal: list[tuple[str, str]]) -> DataFrame:
    """Consecutive states that no legal edge joins; the edges are a literal, as they are few."""
    w = Window.partitionBy(key).orderBy(*order)
    got = df.withColumn("from_state", F.lag(state).over(w)).withColumn("to_state", F.col(state))
    edge = F.concat_ws(">", "from_state", "to_state")
    return got.filter(F.col("from_state").isNotNull() & ~edge.isin([f"{a}>{b}" for a, b in legal]))
