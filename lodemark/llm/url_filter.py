"""URL filters: host and path rules first, then a list of canonical URLs.

The list becomes a blocked Bloom filter: each URL sets BLOCK_HASHES bits of one
64-bit block. Rows whose block lacks a bit are certainly not listed and never
move; the others meet the list in an exact hash join, which removes the false
positives. The filter has at most 2**MAX_BLOCK_BITS blocks (8 MB) however long
the list is: beyond that more rows reach the join, and none is judged wrongly.

Defined results: a null url, or one without ``://``, has empty host and path,
fits no rule and is not listed; null and empty entries of the list count for
nothing; repeated rows are judged alike, each for itself; with an empty list
every row that fits no rule is allowed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_BLOCK_BITS = 20
KEYS_PER_BLOCK = 4
BLOCK_HASHES = 4
#: Rules are an expression, not a join, so they stay few.
MAX_RULES = 1000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)(\?[^#]*)?"
_DROPPED = r"^(utm_[^=]*|ref)(=.*)?$"


def _part(url: Column, group: int) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, group), F.lit(""))


def host(url: Column) -> Column:
    return F.translate(_part(url, 1), UPPER, LOWER)


def path(url: Column) -> Column:
    return _part(url, 2)


def canonical(url: Column) -> Column:
    """Host without www., path without a last slash, query without tracking parameters and sorted; no scheme or fragment. Null without a host."""
    site = F.regexp_replace(host(url), r"^www\.", "")
    query = F.array_sort(F.filter(F.split(F.substring(_part(url, 3), 2, 1 << 30), "&"), lambda p: (p != "") & ~p.rlike(_DROPPED)))
    whole = F.concat(site, F.regexp_replace(path(url), "/$", ""), F.when(F.size(query) > 0, F.concat(F.lit("?"), F.array_join(query, "&"))).otherwise(""))
    return F.when(site != "", whole)


def fits(site: Column, at: Column, rule: str) -> Column:
    rule_host, slash, rest = rule.partition("/")
    return ((site == rule_host) | site.endswith(f".{rule_host}")) & at.startswith(slash + rest)


def _block(h: Column, bits: int) -> Column:
    return h.bitwiseAND(F.lit((1 << bits) - 1)).cast("int")


def _mask(h: Column) -> Column:
    """The bits of a URL inside its block, from the hash's high bits."""
    mask = F.lit(0).cast("long")
    for i in range(BLOCK_HASHES):
        place = F.shiftrightunsigned(h, 64 - 6 * (i + 1)).bitwiseAND(F.lit(63)).cast("int")
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), place))
    return mask


def bloom_blocks(listed: DataFrame) -> tuple[DataFrame, int]:
    """One row with the filter's blocks as an array of longs, and the number of bits that name a block. listed has u."""
    bits = min(MAX_BLOCK_BITS, max(4, (listed.count() // KEYS_PER_BLOCK).bit_length()))
    h = F.xxhash64("u")
    full = listed.select(_block(h, bits).alias("i"), _mask(h).alias("m")).unionByName(
        listed.sparkSession.range(1 << bits).select(F.col("id").cast("int").alias("i"), F.lit(0).cast("long").alias("m"))
    )
    blocks = full.groupBy("i").agg(F.bit_or("m").alias("m")).agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("b"))
    return blocks.select(F.transform("b", lambda x: x["m"]).alias("blocks")), bits


def filter_urls(pages: DataFrame, listed_urls: DataFrame, rules: list[tuple[str, str]], url: str = "url", key: str = "page_id") -> DataFrame:
    """Per row: key, host, path, rule, verdict. rules are (allow or block, host/path), listed_urls has one column of URLs to block."""
    if len(rules) > MAX_RULES:
        raise ValueError("too many rules for an expression")
    listed = listed_urls.select(canonical(F.col(listed_urls.columns[0])).alias("u")).filter(F.col("u").isNotNull()).distinct()
    blocks, bits = bloom_blocks(listed)
    rule, verdict = F, F
    for word, r in sorted(rules, key=lambda x: (-len(x[1]), x[1])):
        rule, verdict = rule.when(fits(F.col("host"), F.col("path"), r), F.lit(r)), verdict.when(F.col("rule") == r, F.lit(word))
    rows = pages.select(key, host(F.col(url)).alias("host"), path(F.col(url)).alias("path"), canonical(F.col(url)).alias("c"))
    rows = rows.withColumn("rule", rule if rules else F.lit(None).cast("string")).withColumn("h", F.xxhash64("c"))
    rows = rows.withColumn("block", F.get(blocks.scalar(), _block(F.col("h"), bits)))
    possible = F.col("rule").isNull() & F.col("c").isNotNull() & (F.col("block").bitwiseAND(_mask(F.col("h"))) == _mask(F.col("h")))
    rows = rows.withColumn("possible", possible)
    told = verdict if rules else F.lit(None).cast("string")
    sure = rows.filter(~F.col("possible")).select(key, "host", "path", "rule", F.coalesce(told, F.lit("allow")).alias("verdict"))
    asked = rows.filter("possible").join(listed.withColumnRenamed("u", "_u"), F.col("c") == F.col("_u"), "left")
    asked = asked.select(key, "host", "path", "rule", F.when(F.col("_u").isNotNull(), F.lit("block")).otherwise(F.lit("allow")).alias("verdict"))
    return sure.unionByName(asked)
