"""Order-dependent decisions against plain sequential passes."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from lodemark.operators import decisions as D


def plain_novel(items):
    seen, out = set(), {}
    for rank, keys in sorted(items, key=lambda x: x[0]):
        out[rank] = not (set(keys or ()) & seen)
        if out[rank]:
            seen |= set(keys or ())
    return out


@pytest.mark.parametrize("seed, n, space", [(1, 60, 8), (2, 200, 60), (3, 300, 1000)])
def test_novelty_equals_the_pass(spark, seed, n, space):
    r = random.Random(seed)
    items = [(i, [str(r.randrange(space)) for _ in range(r.randint(0, 3))]) for i in range(n)] + [(n, None), (n + 1, ["x", "x"]), (n + 2, ["x"])]
    df = spark.createDataFrame(items, "rank long, keys array<string>").repartition(4)
    assert {x["rank"]: x.kept for x in D.greedy_novel(df, "rank", "keys").collect()} == plain_novel(items)


def test_novelty_on_edges_is_not_a_component(spark):
    """A chain: the second falls to the first, so the third stays."""
    df = spark.createDataFrame([(1, ["1-2"]), (2, ["1-2", "2-3"]), (3, ["2-3", "3-4"]), (4, ["3-4"])], "rank long, keys array<string>")
    assert {x["rank"]: x.kept for x in D.greedy_novel(df, "rank", "keys").collect()} == {1: True, 2: False, 3: True, 4: False}
    assert D.greedy_novel(df.limit(0), "rank", "keys").count() == 0


def plain_authorise(rows, limits):
    held, out = {}, {}
    for i, day, amount, asks in sorted(rows, key=lambda x: x[0]):
        h = held.setdefault(day, [])
        why = None
        if asks:
            if sum(h) + amount > limits.total:
                why = "TOTAL_ALLOCATION"
            elif amount > limits.each:
                why = "PER_STRATEGY"
            elif len(h) >= limits.positions:
                why = "POSITIONS"
            elif len(h) >= limits.crowd:
                why = "CORRELATION"
            else:
                h.append(amount)
        out[i] = why
    return out


@pytest.mark.parametrize("limits", [D.Limits(100, 40), D.Limits(100, 40, 2, 9), D.Limits(50, 60, 5, 1), D.Limits(0, 0)])
def test_authorisation_equals_the_pass(spark, limits):
    r = random.Random(limits.total)
    rows = [(i, r.choice(["a", "a", "a", "b", None, str(r.randrange(20))]), r.randint(0, 60), r.random() < 0.8) for i in range(300)]
    df = spark.createDataFrame([(*x, "z") for x in rows], "id long, day string, amount long, asks boolean, reason_ string").repartition(4)
    got = {x.id: x.reason for x in D.authorise(df, "day", "id", "amount", F.col("asks"), limits).collect()}
    assert got == plain_authorise(rows, limits)


def test_authorisation_of_none(spark):
    df = spark.createDataFrame([(1, "a", 5, None)], "id long, day string, amount long, asks boolean")
    assert D.authorise(df, "day", "id", "amount", F.col("asks"), D.Limits(9, 9)).first().reason is None
    assert D.authorise(df.limit(0), "day", "id", "amount", F.col("asks"), D.Limits(9, 9)).count() == 0


@pytest.mark.parametrize("policy, length", [(D.Policy(trades=2, retire=6), 7), (D.Policy(trades=0, retire=20, dwell=3), 2), (D.Policy(), 50)])
def test_lifecycle_equals_the_replay(spark, policy, length):
    r = random.Random(length)
    rows, want = [], {}
    for entity in range(12):
        days = sorted(r.randrange(5, 150) for _ in range(r.choice([1, 5, 60, 200])))
        mood = 0.6
        events = []
        for d in days:
            mood += r.gauss(0, 0.3) if r.random() < 0.9 else -mood
            events.append((d, round(mood, 3), r.randrange(0, 60), 0.6 if r.random() < 0.03 else 0.1))
        rows += [(f"e{entity}", *e, i) for i, e in enumerate(events)]
        phases = list(D.replay(events, policy))
        changes = sum(a[:2] != b[:2] for a, b in zip([("ACTIVE", days[0]), *phases], phases, strict=False))
        want[f"e{entity}"] = (*phases[-1], changes, len(events), max(e[1] for e in events))
    df = spark.createDataFrame(rows, "who string, day int, sharpe double, trades int, dd double, seq int").repartition(5)
    got = {x.who: (x.phase, x.since, x.good_runs, x.bad_runs, x.moves, x.evaluations, x.best_sharpe) for x in D.lifecycle(df, "who", "day", policy, length).collect()}
    assert got == want and len({x[0] for x in want.values()}) > 1


def test_one_entity_is_spread_over_its_buckets(spark):
    """No task gets more than a bucket: the groups that reach Python are buckets, however many evaluations one entity has."""
    rows = spark.range(20_000).selectExpr("'a' AS who", "cast(id / 20 AS int) AS day", "id AS seq", "sin(id / 300.0) AS sharpe", "50 AS trades", "0.1 AS dd")
    got = D.lifecycle(rows, "who", "day", D.Policy(retire=30), 8).first()
    events = [(x.day, x.sharpe, x.trades, x.dd) for x in rows.orderBy("seq").collect()]
    assert (got.phase, got.since, got.good_runs, got.bad_runs) == list(D.replay(events, D.Policy(retire=30)))[-1]
    assert got.evaluations == 20_000


def test_bucket_maps_compose():
    policy, r = D.Policy(trades=0, retire=4), random.Random(1)
    events = pd.DataFrame([(d, r.uniform(-0.3, 1.2), 9, 0.1, False) for d in range(0, 12)], columns=["day", "sharpe", "trades", "dd", "first"])
    whole, one, two = D.bucket_map(events, 0, 12, policy), D.bucket_map(events[:6], 0, 6, policy), D.bucket_map(events[6:], 6, 6, policy)
    assert [x["to"] for x in whole] == [two[x["to"]]["to"] for x in one]
    assert [x["moves"] for x in whole] == [x["moves"] + two[x["to"]]["moves"] for x in one]


def test_lifecycle_of_nothing(spark):
    df = spark.createDataFrame([], "who string, day int, sharpe double, trades int, dd double, seq int")
    assert D.lifecycle(df, "who", "day").count() == 0
