"""Selection in folds against a plain rescan, what a fold must not see, and forests that repeat."""

import math
import random
import statistics

from pyspark.sql import functions as F

from lodemark.operators import folds as FO
from lodemark.operators import models as M

SCHEMA = "series string, config int, pos int, x double"


def made(seed=1, n=90):
    r = random.Random(seed)
    return [("a", c, p, None if r.random() < 0.1 * c else r.gauss(0.01 * c, 1)) for c in (1, 2, 3) for p in range(n)] + [("b", c, p, 0.5) for c in (1, 2) for p in range(n - 30)] + [("c", 1, p, 1.0) for p in range(10)]


def run(spark, rows, horizon=1):
    df = spark.createDataFrame(rows, SCHEMA)
    lengths = df.groupBy("series").agg((F.max("pos") + 1).alias("len"))
    scores = FO.scored(df, FO.windows(lengths, "len", 30, 10, 10), "series", "config", "pos", "x", horizon)
    return scores, FO.best(scores, "series", "config")


def plain(rows, horizon=1):
    def ratio(x):
        return round(statistics.mean(x) / statistics.stdev(x), 9) if len(x) > 1 and statistics.stdev(x) > 1e-9 else 0.0

    out = {}
    for s in {r[0] for r in rows}:
        n = 1 + max(r[2] for r in rows if r[0] == s)
        for start in range(0, n - 40 + 1, 10):
            found = []
            for c in {r[1] for r in rows if r[0] == s}:
                x = {r[2]: r[3] for r in rows if r[:2] == (s, c) and r[3] is not None}
                train = [v for p, v in x.items() if start <= p < start + 30 - horizon]
                test = [v for p, v in x.items() if start + 30 <= p < start + 40 - horizon]
                if len(train) >= 3:
                    found.append((-ratio(train), c, len(train), len(test), ratio(test), round(sum(test), 9)))
            if found:
                out[s, start] = min(found)
    return out


def test_folds_equal_a_rescan(spark):
    rows = made()
    got = {(r.series, r.start): (-r.train_sr, r.config, r.train_n, r.test_n, r.test_sr, r.test_sum) for r in run(spark, rows)[1].collect()}
    want = plain(rows)
    assert got.keys() == want.keys() and len(want) == 6 + 3
    assert all(all(math.isclose(a, b, abs_tol=1e-8) for a, b in zip(got[k], want[k], strict=True)) for k in want)


def test_selection_does_not_see_the_test_slice(spark):
    """Later returns, and those that look into the test slice, change nothing; without the gap they do."""
    rows = made(3)
    changed = [(s, c, p, x if p < 29 else 50.0 * c if c == 1 else -50.0) for s, c, p, x in rows]
    first = lambda got: {r.series: (r.config, r.train_sr) for r in got.filter("start = 0").collect()}
    assert first(run(spark, rows)[1]) == first(run(spark, changed)[1])
    assert first(run(spark, rows, 0)[1]) != first(run(spark, changed, 0)[1])


def test_windows_end_inclusive_or_not(spark):
    df = spark.createDataFrame([("a", 40), ("b", 41), ("c", 10)], "series string, len long")
    assert {r.series for r in FO.windows(df, "len", 30, 10, 5).collect()} == {"a", "b"}
    assert [r.series for r in FO.windows(df, "len", 30, 10, 5, inclusive=False).collect()] == ["b"]


def test_forest_repeats_and_finds_a_plain_split(spark):
    r = random.Random(5)
    rows = [(p, float(r.random()), float(r.random())) for p in range(400)]
    df = spark.createDataFrame([(p, a, b, int(a > 0.4)) for p, a, b in rows], "pos int, a double, b double, label int")
    runs = [M.oos_probabilities(d, ["a", "b"], "label", "pos", [(0, 200, 300), (100, 300, 400)], warm_up=10, trees=20) for d in (df, df.repartition(5))]
    got, again = ({x.pos: (x.window, x.probability) for x in d.collect()} for d in runs)
    assert got == again and sorted(got) == list(range(200, 400))
    cut = max((sum((a > t) == (a > 0.4) for p, a, _ in rows if 10 <= p < 199), -t) for t in [a for _, a, _ in rows])  # an exhaustive split
    assert sum((got[p][1] > 0.5) == (a > -cut[1]) for p, a, _ in rows if p >= 200) >= 194


def test_forest_without_rows_or_with_one_class(spark):
    df = spark.createDataFrame([(p, float(p), 1 if p < 60 else None) for p in range(80)], "pos int, a double, label int")
    got = M.oos_probabilities(df, ["a"], "label", "pos", [(0, 50, 60), (75, 76, 80)], warm_up=5)
    assert {x.probability for x in got.collect()} == {1.0} and got.count() == 10
    assert M.oos_probabilities(df.limit(0), ["a"], "label", "pos", [(0, 50, 60)]).count() == 0
