"""Text and set columns of research records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Indicator and rule tags by category, as patterns over lower-cased text.
TAG_PATTERNS = {
    "trend": {"sma": r"\bsma\b", "ema": r"\bema\b", "macd": r"\bmacd\b", "adx": r"\badx\b"},
    "oscillator": {"rsi": r"\brsi\b", "stochastic": r"stochastic", "cci": r"\bcci\b"},
    "risk": {"stop": r"stop[- ]?loss", "trail": r"trailing", "target": r"take[- ]?profit"},
}


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z0-9]+)"), F.lit(1))


def normalise(text: Column) -> Column:
    return F.array_join(tokens(text), " ")


def signature(text: Column) -> Column:
    return F.sha2(normalise(text), 256)


def mechanism_signature(text: Column) -> Column:
    """Numbers do not tell mechanisms apart."""
    return F.sha2(F.regexp_replace(normalise(text), "[0-9]+", "N"), 256)


def jaccard(a: Column, b: Column) -> Column:
    """Of two token sets; 1 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def similarity_class(sim: Column) -> Column:
    return F.when(sim >= 1, "EXACT").when(sim >= 0.6, "NEAR").when(sim >= 0.3, "RELATED").when(sim >= 0.01, "WEAK").otherwise("NOVEL")


def content_id(prefix: str, payload: Column) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha2(payload, 256), 1, 16))


def combination_count(dims: Column, parameters: Column) -> Column:
    """Product of max(1, size) over an array of arrays and a map of arrays."""
    times = lambda sizes: F.aggregate(sizes, F.lit(1).cast("long"), lambda a, x: a * x)
    return times(F.transform(dims, lambda d: F.greatest(F.lit(1), F.size(d)).cast("long"))) * times(F.transform(F.map_values(parameters), lambda v: F.size(v).cast("long")))


def suffixed_number(x: Column) -> Column:
    """202K is 202000; K M B T multiply, % is only stripped, commas go, empty or - is null."""
    s = F.upper(F.trim(F.regexp_replace(x, "[,%]", "")))
    unit = F.regexp_extract(s, "([KMBT])$", 1)
    by = F.when(unit == "K", 1e3).when(unit == "M", 1e6).when(unit == "B", 1e9).when(unit == "T", 1e12).otherwise(1.0)
    number = F.regexp_extract(s, r"^(-?[0-9]*\.?[0-9]+)[KMBT]?$", 1)
    return F.when(number != "", number.cast("double") * by)


def atr_multiple(x: Column) -> Column:
    n = F.regexp_extract(x, r"(?i)([0-9]+(?:\.[0-9]+)?)\s*x\s*atr", 1)
    return F.when(n != "", n.cast("double"))


def vague(x: Column) -> Column:
    return F.coalesce(F.trim(x), F.lit("")).rlike(r"(?i)^(|n/?a|none|tbd|todo|unknown|\?+|-)$")


def base_currency(symbol: Column) -> Column:
    return F.when(symbol.contains("/"), F.split(symbol, "/")[0]).when(F.length(symbol) == 6, F.upper(F.substring(symbol, 1, 3))).otherwise(symbol)


def sentences(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"(?<=[.!?])\s+|\n+"), lambda s: F.trim(s) != "")


def tags(text: Column) -> Column:
    """Map of category to the sorted tags found."""
    low = F.lower(F.coalesce(text, F.lit("")))
    entries = [
        F.struct(F.lit(c).alias("key"), F.sort_array(F.array_compact(F.array(*[F.when(low.rlike(p), t) for t, p in patterns.items()]))).alias("value"))
        for c, patterns in TAG_PATTERNS.items()
    ]
    return F.map_from_entries(F.filter(F.array(*entries), lambda e: F.size(e["value"]) > 0))


def tag_signature(text: Column) -> Column:
    return F.array_join(F.array_sort(F.flatten(F.map_values(tags(text)))), "|")


def citation(text: Column, pattern: str, before: int = 20, after: int = 40) -> Column:
    """Context of the first match, 20 characters before to 40 after its start."""
    at = F.regexp_instr(F.lower(text), F.lit(pattern))
    return F.when(at > 0, F.substring(text, F.greatest(at - before, F.lit(1)), F.lit(before + after)))
