"""Which texts contain which others, as an equi-join on rare parts.

A needle is looked up by that of its GRAM-letter parts which the fewest texts
hold; texts that hold the part are compared with the needle itself. Needles
shorter than GRAM are looked up whole among the texts' parts of their length.
So no needle meets a text that does not share its rarest part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRAM = 4


def parts(text: Column, length: Column | int) -> Column:
    """Distinct parts of a text of the given length; none if it is shorter."""
    n = F.length(text) - length + 1
    places = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(places, lambda i: F.substring(text, i, length)))


def contained(needles: DataFrame, texts: DataFrame, needle: str, text: str, on: list[str] | None = None) -> DataFrame:
    """Rows of needles beside those of texts whose text contains the needle, within equal columns `on` (which both have). Both keep
    their columns, which must not clash otherwise; a null or empty needle is contained in nothing."""
    on = on or []
    given = needles.filter(F.length(needle) > 0).withColumn("_n", F.least(F.length(needle), F.lit(GRAM)))
    lengths = sorted(r[0] for r in given.select("_n").distinct().collect())  # GRAM values at most
    every = F.flatten(F.array(*[parts(F.col(text), F.lit(n)) for n in lengths])) if lengths else F.array().cast("array<string>")
    held = texts.withColumn("_part", F.explode(every))
    counts = held.groupBy(*on, "_part").agg(F.count("*").alias("_c"))
    mine = given.select(*on, needle, "_n").distinct().withColumn("_part", F.explode(parts(F.col(needle), F.col("_n"))))
    rarest = mine.join(counts, [*on, "_part"], "left").groupBy(*on, needle).agg(F.min_by("_part", F.struct(F.coalesce("_c", F.lit(0)), "_part")).alias("_part"))
    return given.join(rarest, [*on, needle]).drop("_n").join(held, [*on, "_part"]).filter(F.contains(text, needle)).drop("_part")
