"""Quality rules as a short-circuit cascade.

Each rule's cost and selectivity are estimated on a bounded sample, in one job:
the cost from the sample's characters, words and lines and what a feature costs
for each of them, the selectivity from which rules reject which documents. The
next rule is always the one with most rejections per cost among the documents
that the rules before it leave; equal ones keep their declared order. The rules
then run in this order, as the branches of one CASE.
A document's words are found once, before the CASE, and each feature where the
first rule that needs it is reached, so a document that a cheap rule rejects
never meets a dear one. The order changes cost only: a document is kept exactly
if no rule rejects it. The report, which shows the base features of every
document, computes those once and only the rest inside the cascade.

Defined results: null and empty texts have no words and fail ``too_short``;
repeated rows are judged alike, each for itself; an empty table gives an empty
result and the declared rule order; columns other than the text pass through
untouched, and the columns added are renamed if they would clash.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, add_all, let, words

SYMBOLS = "#*$%&|<>"
WINDOW = 8


def word_chars(text: Column) -> Column:
    return F.length(F.translate(F.coalesce(text, F.lit("")), SPACES, "")).cast("long")


def n_symbols(text: Column) -> Column:
    text = F.coalesce(text, F.lit(""))
    return (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long")


def word_lines(text: Column) -> Column:
    lines = F.split(F.coalesce(text, F.lit("")), "\n", -1)
    return F.filter(lines, lambda x: x.rlike(r"[^\x20\x09-\x0D]"))


def n_lines(text: Column) -> Column:
    return F.size(word_lines(text)).cast("long")


def n_dup_lines(text: Column) -> Column:
    return let(word_lines(text), lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))


def _covered(starts: Column) -> Column:
    """Positions within WINDOW of the sorted starts."""
    gap = lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(starts, i + 1) - p, F.lit(WINDOW)))
    return add_all(F.transform(starts, lambda p, i: gap(p, i).cast("long")))


def _repeated(windows: Column) -> Column:
    """Starts of windows whose hash occurs again; sorting brings equal ones together."""
    ranked = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def pick(r: Column) -> Column:
        same = lambda x, j: F.coalesce(F.get(r, j)["h"] == x["h"], F.lit(False))
        hits = F.filter(r, lambda x, j: same(x, j - 1) | same(x, j + 1))
        return F.array_sort(F.transform(hits, lambda x: x["i"]))

    return let(ranked, pick)


def n_repeat_words(w: Column) -> Column:
    """Words inside WINDOW-word windows that occur twice or more, the first included."""

    def count(h: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(h) - WINDOW)
        windows = F.transform(at, lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)]))
        dear = lambda w: F.when(  # noqa: E731  sorting only where something repeats
            F.size(F.array_distinct(w)) < F.size(w), let(_repeated(w), _covered)
        ).otherwise(F.lit(0).cast("long"))
        return F.when(F.size(h) >= WINDOW, let(windows, dear)).otherwise(F.lit(0).cast("long"))

    return let(F.transform(w, lambda x: F.xxhash64(x)), count)


def n_alpha(w: Column) -> Column:
    """Words with a letter."""
    return F.size(F.filter(w, lambda x: x.rlike(r"\p{L}"))).cast("long")


def lines_like(text: Column, pattern: str) -> Column:
    return F.size(F.filter(word_lines(text), lambda x: x.rlike(pattern))).cast("long")


#: From a document's text and words.
FEATURES: dict[str, Callable[[Column, Column], Column]] = {
    "n_words": lambda text, w: F.size(w).cast("long"),
    "word_chars": lambda text, w: word_chars(text),
    "n_symbols": lambda text, w: n_symbols(text),
    "n_lines": lambda text, w: n_lines(text),
    "n_dup_lines": lambda text, w: n_dup_lines(text),
    "n_repeat_words": lambda text, w: n_repeat_words(w),
    "n_alpha": lambda text, w: n_alpha(w),
    "n_bullets": lambda text, w: lines_like(text, r"^[\x20\x09]*[-*•]"),
    "n_ellipses": lambda text, w: lines_like(text, r"(\.\.\.|…)[\x20\x09]*\z"),
}
#: What a feature costs, in nanoseconds for each character, word and line; only their relations matter. Words are found before any rule.
COSTS: dict[str, tuple[float, float, float]] = {
    "n_words": (0, 0, 0), "word_chars": (8, 0, 0), "n_symbols": (8, 0, 0), "n_lines": (6, 0, 150), "n_dup_lines": (6, 0, 250),
    "n_repeat_words": (0, 400, 0), "n_alpha": (0, 120, 0), "n_bullets": (6, 0, 300), "n_ellipses": (8, 0, 400),
}
#: A comparison's cost, and that of a feature which states none.
LEAST_COST, OTHER_COST = 20.0, (20.0, 100.0, 100.0)
#: What the report shows.
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Rule:
    """``rejects`` gets a getter of features and returns a boolean that is never null."""

    name: str
    rejects: Callable[[Callable[[str], Column]], Column]
    base: bool = False


RULES = (
    Rule("too_short", lambda f: f("n_words") < 20, True),
    Rule("repeats", lambda f: 100 * f("n_repeat_words") > 30 * f("n_words"), True),
    Rule("symbols", lambda f: 10 * f("n_symbols") > f("n_words")),
    Rule("dup_lines", lambda f: 100 * f("n_dup_lines") > 30 * f("n_lines")),
    Rule("word_length", lambda f: (f("word_chars") < 2 * f("n_words")) | (f("word_chars") > 15 * f("n_words"))),
    Rule("few_letters", lambda f: 2 * f("n_alpha") < f("n_words")),
    Rule("bullets", lambda f: 10 * f("n_bullets") > 9 * f("n_lines")),
    Rule("ellipses", lambda f: 2 * f("n_ellipses") > f("n_lines")),
)


def features_of(rule: Rule) -> list[str]:
    """The features that a rule asks for."""
    asked: list[str] = []
    rule.rejects(lambda name: asked.append(name) or F.lit(0))
    return list(dict.fromkeys(asked))


def by_rejections_per_cost(rules: tuple[Rule, ...], seen: list[tuple[str, int, int, int, int]]) -> list[Rule]:
    """seen: which rules reject ("0110..."), in how many documents, and these documents' characters, words and lines."""
    left, out = list(enumerate(rules)), []
    while left:

        def worth(at: tuple[int, Rule]) -> tuple[float, float]:
            n, sizes = max(1, sum(x[1] for x in seen)), [sum(x[k] for x in seen) for k in (2, 3, 4)]  # noqa: B023
            unit = [sum(COSTS.get(f, OTHER_COST)[k] for f in features_of(at[1])) for k in range(3)]
            cost = LEAST_COST + sum(u * x for u, x in zip(unit, sizes, strict=True)) / n
            return sum(x[1] for x in seen if x[0][at[0]] == "1") / cost, -cost  # noqa: B023

        best = max(left, key=worth)  # the first of equal ones
        left.remove(best)
        out.append(best[1])
        seen = [x for x in seen if x[0][best[0]] == "0"] or seen
    return out


def measured_order(
    df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, sample_rows: int = 2000, seed: int = 7
) -> list[Rule]:
    """The rules in the order of the cascade, from a sample of at most sample_rows documents."""
    total = df.count()
    if not total or not rules:
        return list(rules)
    sample = df.select(F.col(text).alias("text")).sample(min(1.0, 1.2 * sample_rows / total), seed).limit(sample_rows)
    t = F.col("text")

    def judged(w: Column) -> Column:
        bits = [rule.rejects(lambda name: FEATURES[name](t, w)).cast("int").cast("string") for rule in rules]
        sizes = F.coalesce(F.length(t), F.lit(0)).cast("long").alias("chars"), F.size(w).cast("long").alias("words"), n_lines(t).alias("lines")
        return F.struct(F.concat(*bits).alias("bits"), *sizes)

    rows = sample.select(let(words(t), judged).alias("x")).groupBy("x.bits").agg(F.count("*").alias("n"), *[F.sum(f"x.{c}").alias(c) for c in ("chars", "words", "lines")])
    return by_rejections_per_cost(rules, sorted((r["bits"], r["n"], r["chars"], r["words"], r["lines"]) for r in rows.collect()))  # at most a row for each sampled document


def cascade(order: list[Rule], get: Callable[[str], Column]) -> Column:
    """Name of the first rule in this order that rejects, else null."""
    first = F
    for rule in order:
        first = first.when(rule.rejects(get), F.lit(rule.name))
    return first if order else F.lit(None).cast("string")


def verdict(text: Column, order: list[Rule]) -> Column:
    """The cascade over a text whose words are found once; other features only where a rule is reached."""
    return let(words(text), lambda w: cascade(order, lambda name: FEATURES[name](text, w)))


def quality_filter(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, sample_rows: int = 2000) -> DataFrame:
    """The rows that no rule rejects, with their columns as they are."""
    return df.filter(verdict(F.col(text), measured_order(df, text, rules, sample_rows)).isNull())


def quality_report(df: DataFrame, text: str = "text", key: str = "doc_id", rules: tuple[Rule, ...] = RULES, sample_rows: int = 2000) -> DataFrame:
    """Per document: the base features, whether a base rule fails, and the cascade's verdict."""
    order, t = measured_order(df, text, rules, sample_rows), F.col(text)

    def judged(w: Column) -> Column:
        def with_base(b: Column) -> Column:
            get = lambda name: b[name] if name in BASE else FEATURES[name](t, w)
            failed = cascade([r for r in order if r.base], get).isNotNull()
            return F.struct(*[b[x].alias(x) for x in BASE], failed.alias("base_failed"), cascade(order, get).isNull().alias("kept"))

        return let(F.struct(*[FEATURES[x](t, w).alias(x) for x in BASE]), with_base)

    return df.select(F.col(key).alias("doc_id"), let(words(t), judged).alias("judged")).select("doc_id", "judged.*")
