"""Forward as-of joins: the first bar at or after a time.

Probes and bars fall into buckets of time, so a busy symbol spreads over its
buckets. With a tolerance the buckets are as wide as it, and a probe asks its
own bucket and the next. Without one, probes and bars of a bucket are merged in
one window, and a probe past its bucket's last bar takes the first bar of the
next bucket that has any: one row per bucket, found over those rows alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _epoch(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def _nearest(asks: DataFrame, bars: DataFrame, size: int, values: list[str], by: str) -> DataFrame:
    """(_id, _m) of the first bar at most size microseconds after each of asks (_id, _by, _t) that has one."""
    left = asks.withColumn("_bucket", F.explode(F.array(F.floor(F.col("_t") / size), F.floor(F.col("_t") / size) + 1)))
    right = bars.select(F.col(by).alias("_by"), F.floor(_epoch(F.col("ts")) / size).alias("_bucket"), _epoch(F.col("ts")).alias("_u"), F.struct(F.col("ts").alias("match_ts"), *values).alias("_m"))
    hits = left.join(right, ["_by", "_bucket"]).filter((F.col("_u") >= F.col("_t")) & (F.col("_u") <= F.col("_t") + size))
    return hits.groupBy("_id").agg(F.min_by("_m", "_u").alias("_m"))


def forward_tolerance(probes: DataFrame, bars: DataFrame, seconds: int, values: list[str], by: str = "symbol", at: str = "probe_ts", key: str = "probe_id", hourly: bool = False) -> DataFrame:
    """probes plus match_ts and the values of the first bar in [probe, probe + seconds], null if there is none. key is unique.
    hourly: bars begin on whole hours, so all probes inside an hour have the same first bar; it is looked up once for an hour, and the
    probes themselves are neither shuffled nor grouped (key is not used then)."""
    size = seconds * 1_000_000
    if not hourly:
        best = _nearest(probes.select(F.col(key).alias("_id"), F.col(by).alias("_by"), _epoch(F.col(at)).alias("_t")), bars, size, values, by)
        return probes.join(best, F.col(key) == F.col("_id"), "left").select(*probes.columns, "_m.*")
    hour = F.date_trunc("hour", F.col(at)).cast(probes.schema[at].dataType)
    cell = F.struct(F.col(by).alias("by"), hour.alias("hour"), (F.col(at) == hour).alias("on"))
    asks = probes.select(cell.alias("_id")).distinct()
    asks = asks.select("_id", F.col("_id.by").alias("_by"), (_epoch(F.col("_id.hour")) + F.when(F.col("_id.on"), 0).otherwise(1)).alias("_t"))
    best = F.broadcast(_nearest(asks, bars, size + 3_600_000_000, values, by))  # two rows an hour and series at most
    got = probes.withColumn("_cell", cell).join(best, F.col("_cell") == F.col("_id"), "left")
    near = F.when(_epoch(F.col("_m.match_ts")) <= _epoch(F.col(at)) + size, F.col("_m"))
    return got.withColumn("_m", near).select(*probes.columns, "_m.*")


def forward(probes: DataFrame, bars: DataFrame, values: list[str], by: str = "symbol", at: str = "probe_ts", seconds: int = 86_400) -> DataFrame:
    """probes plus match_ts and the values of the first bar at or after each probe; null past the end. Buckets are `seconds` wide."""
    some = F.struct(F.col("ts").alias("match_ts"), *values)
    kind = bars.select(some.alias("m")).schema["m"].dataType
    bucket = lambda t: F.floor(_epoch(F.col(t)) / (seconds * 1_000_000)).alias("_bucket")
    rows = bars.select(F.col(by).alias("_by"), bucket("ts"), F.col("ts").alias("_t"), F.lit(1).alias("_bar"), some.alias("_m"), F.lit(None).cast(probes.schema).alias("_p"))
    asks = probes.select(F.col(by).alias("_by"), bucket(at), F.col(at).alias("_t"), F.lit(0).alias("_bar"), F.lit(None).cast(kind).alias("_m"), F.struct(*probes.columns).cast(probes.schema).alias("_p"))
    every = rows.unionByName(asks)
    # searching backwards in time, a bar stands before the probes of its own time
    w = Window.partitionBy("_by", "_bucket").orderBy(F.desc("_t"), F.desc("_bar")).rowsBetween(Window.unboundedPreceding, 0)
    got = every.withColumn("_m", F.last("_m", ignorenulls=True).over(w)).filter(F.col("_bar") == 0)
    firsts = every.groupBy("_by", "_bucket").agg(F.min_by("_m", F.when(F.col("_bar") == 1, F.col("_t"))).alias("_first"))
    after = Window.partitionBy("_by").orderBy("_bucket").rowsBetween(1, Window.unboundedFollowing)  # a row per bucket
    firsts = firsts.select(F.col("_by").alias("_b"), F.col("_bucket").alias("_k"), F.first("_first", ignorenulls=True).over(after).alias("_next"))
    got = got.join(firsts, F.col("_by").eqNullSafe(F.col("_b")) & F.col("_bucket").eqNullSafe(F.col("_k")), "left")
    return got.withColumn("_m", F.coalesce("_m", "_next")).select("_p.*", "_m.*")
