"""Draws from a product space without repetition and without building it.

A draw is the image of its number under a keyed permutation (a Feistel network
of four rounds over hashes) of the least power of four that holds the space;
numbers whose image lies outside are no draws, of which there are at most three
in four. The image is read as a number of mixed radix, one digit a dimension,
by long division over limbs where it would not fit a long.
A draw depends on nothing but the seed and its number, so any partitioning, and
any range of numbers, gives the same candidates.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROUNDS = 4


def hashed(*parts: Column, digits: int = 8) -> Column:
    """A number of that many hexadecimal digits (below 2^32 by default) from the md5 of the parts joined by colons."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[p.cast("string") for p in parts]).cast("binary")), 1, digits), 16, 10).cast("long")


def half_bits(size: int) -> int:
    """Bits of each half of the permuted numbers."""
    return max(1, math.ceil((size - 1).bit_length() / 2))


def _div(x: Column, y: int) -> Column:
    """The whole quotient of longs; a double's would be wrong beyond 2^53."""
    return F.call_function("div", x, F.lit(y).cast("long"))


def permuted(i: Column, size: int, seed: str) -> Column:
    """The image of i, below the power of four that holds size, as a struct of its upper and lower half."""
    half = 1 << half_bits(size)
    start = F.struct(_div(i, half).alias("l"), F.pmod(i, F.lit(half)).cast("long").alias("r"))
    wide = 8 if half <= 1 << 32 else 15  # hexadecimal digits that fill a half
    turn = lambda p, n: F.struct(p["r"].alias("l"), p["l"].bitwiseXOR(F.pmod(hashed(F.lit(seed), n, p["r"], digits=wide), F.lit(half))).alias("r"))
    return F.aggregate(F.array(*map(F.lit, range(ROUNDS))), start, turn)


def draws(spark: SparkSession, sizes: list[int], first: int, last: int, seed: str) -> DataFrame:
    """(i, d0, d1, ...): the draws of the numbers in [first, last); distinct, as long as last is no more than the space. A space of
    more than 2^53 points needs dimensions below 2^30, as its numbers are divided limb by limb."""
    size = reduce(lambda a, b: a * b, sizes, 1)
    names = [f"d{j}" for j in range(len(sizes))]
    if size >= 1 << 120 or (size >= 1 << 53 and max(sizes) >= 1 << 30):
        raise ValueError("the space has more than 2^120 points, or more than 2^53 and a dimension of 2^30 values or more")
    if not size:
        return spark.range(0).select(F.col("id").alias("i"), *[F.lit(0).cast("long").alias(d) for d in names])
    bits, image = half_bits(size), F.col("_p")
    if size < 1 << 53:
        limbs, widths = [image["l"] * (1 << bits) + image["r"]], [2 * bits]
    elif bits <= 32:
        limbs, widths = [image["l"], image["r"]], [bits, bits]
    else:
        low = bits // 2  # a remainder and the next limb fit a long
        limbs, widths = [x for h in ("l", "r") for x in (_div(image[h], 1 << low), F.pmod(image[h], F.lit(1 << low)))], [bits - low, low] * 2
    at = [f"_q{k}" for k in range(len(limbs))]
    got = spark.range(first, last).select(F.col("id").alias("i"), permuted(F.col("id"), size, seed).alias("_p")).select("i", *[x.cast("long").alias(q) for x, q in zip(limbs, at, strict=True)])
    below, rest = F.lit(False), size
    for q, width in zip(reversed(at), reversed(widths), strict=True):  # from the lowest limb: the higher one decides unless equal
        rest, part = divmod(rest, 1 << width) if q != at[0] else (0, rest)
        below = (F.col(q) < part) | ((F.col(q) == part) & below)
    got = got.filter(below)
    for d, n in reversed(list(zip(names, sizes, strict=True))):  # long division, a projection a dimension
        left, quotients = F.lit(0).cast("long"), []
        for q, width in zip(at, widths, strict=True):
            over = F.col(q) if q == at[0] else left * (1 << width) + F.col(q)
            quotients.append(_div(over, n).alias(q))
            left = F.pmod(over, F.lit(n).cast("long"))
        got = got.select("i", *[c for c in got.columns if c in names], left.alias(d), *quotients)
    return got.select("i", *names)


def next_population(scored: DataFrame, fresh: DataFrame, sizes: list[int], generation: int, seed: str, elites: int = 20, children: int = 3) -> DataFrame:
    """(origin, i, child, d0, ...): the best of scored (i, d0, ..., fitness; ties to the lesser i) as they are, children of each with one
    dimension set anew, both chosen by hash, and all of fresh (i, d0, ...)."""
    names = [f"d{j}" for j in range(len(sizes))]
    best = scored.orderBy(F.desc("fitness"), "i").limit(elites).select("i", *names)
    born = best.withColumn("child", F.explode(F.sequence(F.lit(0), F.lit(children))))  # the elite itself is 0, so scored is ranked once
    pick = lambda what: hashed(F.lit(seed), F.lit(what), F.lit(generation), F.col("i"), F.col("child"))
    at = F.when(F.col("child") > 0, F.pmod(pick("dimension"), F.lit(len(sizes))))
    # one of the other values: a step of at least one and less than the dimension
    moved = [F.when(at == j, F.pmod(F.col(n) + 1 + F.pmod(pick("value"), F.lit(max(1, s - 1))), F.lit(s))).otherwise(F.col(n)).alias(n) for j, (n, s) in enumerate(zip(names, sizes, strict=True))]
    rows = born.select(F.when(F.col("child") > 0, "child").otherwise("elite").alias("origin"), "i", "child", *moved)
    return rows.unionByName(fresh.select(F.lit("random").alias("origin"), "i", F.lit(0).alias("child"), *names))
