"""Exact quantiles of groups of any size, by selection.

A quantile lies between two order statistics. Each is searched for in a bracket
of values that holds it: a histogram of BINS parts of the bracket, counted
with map-side combine and carrying each part's least and greatest value, names
the part that holds the rank, whose values are the next bracket. A bracket of
one value is the answer. A round shrinks brackets thousandfold, so there are a
few rounds; no group of rows ever meets in a task, only counts do.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .chains import cut_lineage

BINS = 4096
#: Most brackets that are broadcast; a group has two a quantile.
SMALL = 100_000


def _part():
    """Which of the bracket's parts holds a value: parts of equal ratio while the bracket spans several powers of two, then of equal width.
    Both ends of a bracket are never in one part, so every round shrinks it."""
    x, lo, hi = F.col("_x"), F.col("_lo"), F.col("_hi")
    scale = lambda v: F.when(v == 0, 0.0).otherwise(F.signum(v) * (F.log2(F.abs(v)) + 1100))  # noqa: E731  above 0 for the least double
    near = ((lo > 0) & (hi <= 4 * lo)) | ((hi < 0) & (lo >= 4 * hi))
    place = F.when(near, (x - lo) / F.nullif(hi - lo, F.lit(0.0))).otherwise((scale(x) - scale(lo)) / F.nullif(scale(hi) - scale(lo), F.lit(0.0)))
    return F.least(F.floor(place * BINS), F.lit(BINS - 1))


def exact_quantiles(df: DataFrame, by: list[str], x: str, shares: list[float]) -> DataFrame:
    """(by, n, quantiles): for each share of [0, 1] the interpolated quantile of x, which holds no NaN; null values do not count, and a
    group without any has no row. Group keys may be null. Every round reads df anew, so cut the lineage of one that shuffles."""
    names = [f"_g{i}" for i in range(len(by))]
    rows = df.select(*[F.col(b).alias(g) for b, g in zip(by, names, strict=True)], F.col(x).cast("double").alias("_x")).filter(F.col("_x").isNotNull())
    sizes = cut_lineage(rows.groupBy(*names).agg(F.count("*").alias("_n"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi")))
    sizes = sizes.filter("_n > 0")
    at = lambda p: F.lit(p) * (F.col("_n") - 1)
    ranks = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(at(p)), F.ceil(at(p))) for p in shares])))
    open_ = sizes.select(*names, F.explode(ranks).alias("_rank"), "_lo", "_hi").withColumn("_k", F.col("_rank"))
    found = open_.filter("_lo = _hi").select(*names, "_rank", F.col("_lo").alias("_v"))
    open_ = cut_lineage(open_.filter("_lo < _hi"))
    while not open_.isEmpty():
        brackets = open_.select(*[F.col(g).alias(f"{g}b") for g in names], "_lo", "_hi").distinct()
        brackets = F.broadcast(brackets) if brackets.count() <= SMALL else brackets
        same = [F.col(g).eqNullSafe(F.col(f"{g}b")) for g in names]
        inside = rows.join(brackets, [*same, F.col("_x").between(F.col("_lo"), F.col("_hi"))])
        counts = inside.groupBy(*names, "_lo", "_hi", _part().alias("_bin")).agg(F.count("*").alias("_c"), F.min("_x").alias("_a"), F.max("_x").alias("_b"))
        before = F.sum("_c").over(Window.partitionBy(*names, "_lo", "_hi").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1))  # at most BINS rows
        counts = counts.withColumn("_before", F.coalesce(before, F.lit(0))).withColumnsRenamed({**{g: f"{g}b" for g in names}, "_lo": "_lob", "_hi": "_hib"})
        holds = [*same, F.col("_lo") == F.col("_lob"), F.col("_hi") == F.col("_hib"), F.col("_k") >= F.col("_before"), F.col("_k") < F.col("_before") + F.col("_c")]
        new = cut_lineage(open_.join(counts, holds).select(*names, "_rank", (F.col("_k") - F.col("_before")).alias("_k"), F.col("_a").alias("_lo"), F.col("_b").alias("_hi")))
        found = found.unionByName(new.filter("_lo = _hi").select(*names, "_rank", F.col("_lo").alias("_v")))
        open_ = new.filter("_lo < _hi")
    values = found.groupBy(*names).agg(F.map_from_entries(F.collect_list(F.struct("_rank", "_v"))).alias("_m"))  # two entries a share

    def one(p: float):
        low, high = F.element_at("_m", F.floor(at(p))), F.element_at("_m", F.ceil(at(p)))
        return F.when(low == high, low).otherwise((F.ceil(at(p)) - at(p)) * low + (at(p) - F.floor(at(p))) * high)

    met = sizes.join(values.withColumnsRenamed({g: f"{g}b" for g in names}), [F.col(g).eqNullSafe(F.col(f"{g}b")) for g in names]) if names else sizes.join(values, F.lit(True))
    return met.select(*[F.col(g).alias(b) for b, g in zip(by, names, strict=True)], F.col("_n").alias("n"), F.array(*[one(p) for p in shares]).alias("quantiles"))
