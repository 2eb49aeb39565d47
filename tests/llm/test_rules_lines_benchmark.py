"""Quality rules, line dedup and decontamination against plain Python, and their defined edge cases."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from lodemark.llm import decontaminate as D
from lodemark.llm import line_dedup as L
from lodemark.llm import quality as R

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_features(text):
    text = text or ""
    w = WORD.findall(text)
    seen, lines, dup = {}, [x for x in text.split("\n") if WORD.search(x)], 0
    for i in range(len(w) - 7):
        seen.setdefault(tuple(w[i : i + 8]), []).append(i)
    repeated = {i + k for at in seen.values() if len(at) > 1 for i in at for k in range(8)}
    dup = len(lines) - len(set(lines))
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(repeated)


def test_quality_features(documents):
    got = {(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in R.quality_report(documents).collect()}
    assert got == {(d.doc_id, *plain_features(d.text)) for d in documents.collect()}


def test_quality_order_changes_nothing(documents):
    verdict = lambda order: [r[0] for r in documents.select(R.verdict(F.col("text"), order).isNull()).collect()]
    assert verdict(list(R.RULES)) == verdict(list(R.RULES)[::-1])


def test_quality_verdicts_match_plain_rules(spark, documents):
    good = " ".join(f"word{i}" for i in range(30))
    texts = [good, "\n".join(f"- {good} {i}" for i in range(5)), "\n".join(f"{good} {i}..." for i in range(5)), " ".join(str(i) for i in range(40)),
             good + " " + "#" * 5, "\n".join([good] * 3), " ".join("x" * 20 + str(i) for i in range(30)), good + "\n• a\n* b\n- c…\r"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").unionByName(documents.select("doc_id", "text"))

    def keeps(text):
        n, chars, symbols, dup, repeated = plain_features(text)
        lines = [x for x in (text or "").split("\n") if WORD.search(x)]
        alpha = sum(any(c.isalpha() for c in w) for w in WORD.findall(text or ""))
        base = n < 20 or 100 * repeated > 30 * n
        rest = 10 * symbols > n or 100 * dup > 30 * len(lines) or not 2 * n <= chars <= 15 * n or 2 * alpha < n
        marks = [re.match(r"[ \t]*[-*•]", x) for x in lines], [re.search(r"(\.\.\.|…)[ \t]*\Z", x) for x in lines]
        return base, not (base or rest or 10 * sum(map(bool, marks[0])) > 9 * len(lines) or 2 * sum(map(bool, marks[1])) > len(lines))

    got = sorted((str(r.doc_id), r.base_failed, r.kept) for r in R.quality_report(docs).collect())
    assert got == sorted((str(d.doc_id), *keeps(d.text)) for d in docs.collect())
    assert [k for k in range(8) if keeps(texts[k])[1]] == [0, 7]
    assert sorted(map(str, R.quality_filter(docs).collect())) == sorted(str(d) for d in docs.collect() if keeps(d.text)[1])


def test_quality_puts_cheap_strict_rules_first(spark):
    docs = spark.createDataFrame([(i, "a b c") for i in range(300)], "doc_id long, text string")
    order = R.measured_order(docs)
    assert order[0].name == "too_short" and sorted(r.name for r in order) == sorted(r.name for r in R.RULES)
    assert [r.name for r in R.measured_order(docs.repartition(5))] == [r.name for r in order]


def test_order_follows_what_earlier_rules_leave():
    """Rule 1 rejects more than rule 2, but nearly all of that is gone after rule 0."""
    rule = lambda name, *features: R.Rule(name, lambda f: [f(x) for x in features])
    rules = (rule("a", "n_words"), rule("b", "n_symbols"), rule("c", "n_symbols"), rule("d", "n_symbols"), rule("never", "n_words"))
    seen = [("11000", 90, 9000, 900, 9), ("01000", 1, 100, 10, 1), ("00100", 20, 2000, 200, 2), ("00010", 20, 2000, 200, 2), ("00000", 50, 5000, 500, 5)]
    assert [r.name for r in R.by_rejections_per_cost(rules, seen)] == ["a", "c", "d", "b", "never"]
    assert R.features_of(R.RULES[4]) == ["word_chars", "n_words"] and R.by_rejections_per_cost((), seen) == []
    assert [r.name for r in R.by_rejections_per_cost(rules, [("11111", 5, 500, 50, 5)])] == ["a", "never", "b", "c", "d"]  # dearer ones after, equal ones as declared


def test_quality_filter_keeps_columns(documents, no_documents):
    kept = R.quality_filter(documents)
    assert kept.columns == documents.columns and kept.filter(F.col("doc_id").isin(4, 5)).count() == 3
    assert kept.filter("text is null or text = ''").count() == 0
    assert R.quality_filter(no_documents).count() == 0 and R.quality_report(no_documents).count() == 0


def near(a, b):
    """One word substituted, added or removed."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) <= 1
    if abs(len(a) - len(b)) != 1:
        return False
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_removed(rows):
    """{(doc_id, text): removed line numbers}; rows are (doc_id, text hash, text)."""
    occ = []
    for doc_id, th, text in {(d, h, t) for d, h, t in rows if t}:
        occ += [((doc_id is not None, doc_id or 0, th, i), tuple(WORD.findall(x)), (doc_id, text)) for i, x in enumerate(text.split("\n"))]
    occ = sorted(x for x in occ if len(x[1]) >= L.EXACT_WORDS)
    first, out = {}, {}
    for at, w, _ in occ:
        first.setdefault(w, at)
    for at, w, who in occ:
        earlier = first[w] < at or (len(w) >= L.EDIT_WORDS and any(len(v) >= L.EDIT_WORDS and first[v] < first[w] and near(v, w) for v in first if v != w))
        if earlier:
            out.setdefault(who, []).append(at[3])
    return out


@pytest.fixture(scope="module")
def lined(spark):
    base = [f"w{k}" for k in range(14)]
    variants = [base, base[:5] + ["x"] + base[6:], base[:-1], [*base, "tail"], ["head", *base], base[:3] + ["y", "z"] + base[5:], base[1:13]]
    short = base[:6]
    texts = ["\n".join(" ".join(v) for v in variants[k:] + [short, short[:4]]) for k in range(len(variants))]
    texts += ["", None, "  ".join(base), " ".join(f"long{i}" for i in range(3000)), " ".join(f"long{i}" for i in range(2999)), texts[0]]
    rows = [(i, t) for i, t in enumerate(texts)] + [(0, texts[0]), (None, " ".join(base))]
    return spark.createDataFrame(rows, "doc_id long, text string")


@pytest.mark.parametrize("bounds", [(1, 5), (5, 10)])
def test_lines_match_brute_force(lined, monkeypatch, bounds):
    monkeypatch.setattr(L, "HOT", 2)
    monkeypatch.setattr(L, "EXACT_WORDS", bounds[0])  # of the plain version only
    monkeypatch.setattr(L, "EDIT_WORDS", bounds[1])
    rows = [(r.doc_id, r.h, r.text) for r in lined.withColumn("h", F.xxhash64("text")).collect()]
    want = plain_removed(rows)
    got = L.line_report(lined, exact=bounds[0], near_from=bounds[1]).collect()
    assert len(got) == lined.count()
    expected = sorted((str(d), len((t or "").split("\n")), ",".join(map(str, want.get((d, t), [])))) for d, _, t in rows)
    assert sorted((str(r.doc_id), r.n_lines, r.removed) for r in got) == expected


def test_short_lines_are_compared(spark):
    base, texts = [f"v{k}" for k in range(17)], ["Of.\n\nIn erre to it therble whrehe at.", "Of.\n\nIn erre to it rendon whrehe at.\nkept"]
    for n in range(1, 18):
        line = [f"n{n}", *base[: n - 1]]
        texts += ["\n".join(map(" ".join, (line, line[:-1], [*line[: n // 2], "x", *line[n // 2 + 1 :]]))), "\n".join(map(" ".join, ([*line, "end"], line)))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = plain_removed([(r.doc_id, r.h, r.text) for r in df.withColumn("h", F.xxhash64("text")).collect()])
    got = {r.doc_id: r.text for r in L.dedup_lines(df, drop_emptied=False).collect()}
    assert got[1] == "\nkept" and len(got) == len(texts)
    for d, t in enumerate(texts):
        assert got[d] == "\n".join(x for i, x in enumerate(t.split("\n")) if i not in want.get((d, t), []))


def test_texts_of_lines_without_partners_stay_out_of_shuffles(spark):
    """Words of random digits: no line shares a part but the last two, whose text alone is shuffled."""
    line = "array_join(transform(sequence(1, 60), i -> sha2(concat({}, ':', i), 256)), ' ')"
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.expr(line.format("id")).alias("text"))
    docs = docs.unionByName(spark.range(300, 301).select(F.col("id").alias("doc_id"), F.expr(f"concat({line.format(299)}, ' more')").alias("text")))
    sc = spark.sparkContext._jsc.sc()

    def written():
        sc.listenerBus().waitUntilEmpty(30_000)
        return sc.statusStore().executorList(False).apply(0).totalShuffleWrite()

    before = written()
    got = L.line_report(docs).filter("n_removed > 0").collect()
    assert [(r.doc_id, r.removed) for r in got] == [(300, "0")]
    assert written() - before < 301 * 60 * 32 / 4  # a quarter of what the digits hold


def test_common_line_and_clashing_columns(spark, documents, no_documents):
    line = " ".join(f"k{i}" for i in range(12))
    many = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit(line + "\n"), F.concat_ws(" ", *[F.concat(F.lit(f"u{k}x"), "id") for k in range(12)])).alias("text"))
    assert L.line_report(many).agg(F.sum("n_removed")).first()[0] == 2999
    got = L.dedup_lines(documents)
    assert got.columns == documents.columns
    assert got.filter("doc_id = 9").first().text == documents.filter("doc_id = 9").first().text
    assert L.dedup_lines(no_documents).count() == 0 and L.line_report(no_documents).count() == 0


TOKEN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def plain_report(text, items):
    w = TOKEN.findall(lower(text))
    hit, found = set(), set()
    for item, t in items:
        b = TOKEN.findall(lower(t))
        n = min(13, len(b))
        if n:
            grams = {tuple(b[i : i + n]) for i in range(len(b) - n + 1)}
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in grams:
                    hit |= set(range(i, i + n))
                    found |= {item}
    ids = sorted(str(x) for x in found if x is not None)
    return len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)


def test_contamination(documents, benchmark):
    items = [tuple(r) for r in benchmark.collect()]
    got = D.contamination_report(documents, benchmark).collect()
    rows = sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got)
    assert rows == sorted((str(d.doc_id), *plain_report(d.text, items)) for d in documents.collect())


def test_contaminated_go_or_lose_spans(spark, documents, benchmark, no_documents):
    items = [tuple(r) for r in benchmark.collect()]
    clean = [d for d in documents.collect() if not plain_report(d.text, items)[4]]
    kept = D.drop_contaminated(documents, benchmark)
    assert sorted(map(str, kept.collect())) == sorted(map(str, clean)) and kept.columns == documents.columns
    cut = D.remove_spans(documents, benchmark)
    assert cut.columns == documents.columns and cut.count() == documents.count()
    assert D.contamination_report(cut, benchmark).filter("contaminated").count() == 0
    none = spark.createDataFrame([], "item_id long, text string")
    assert D.contamination_report(documents, none).filter("n_hit > 0").count() == 0
    assert D.drop_contaminated(no_documents, benchmark).count() == 0


def test_long_benchmark_passes_the_broadcast_bound(spark, documents, benchmark, monkeypatch):
    want = sorted(map(str, D.contamination_report(documents, benchmark).collect()))
    monkeypatch.setattr(D, "BROADCAST_WINDOWS", 0)
    monkeypatch.setattr(D, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(D, "LEAST_BITS", 6)
    monkeypatch.setattr(D, "MOST_BITS", 6)  # so full that other windows pass it
    assert sorted(map(str, D.contamination_report(documents, benchmark).collect())) == want


def test_contamination_report_keeps_clashing_columns(spark, documents, benchmark):
    names = ("items", "_h", "h", "hit", "rid")
    docs = documents.select("doc_id", "text", *[F.lit(n).alias(n) for n in names])
    got = D.contamination_report(docs, benchmark, keep=names)
    assert got.count() == documents.count() and all(got.filter(f"`{n}` <> '{n}'").count() == 0 for n in names)
