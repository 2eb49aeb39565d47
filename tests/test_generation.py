"""Draws, resamples and containment against plain versions."""

import hashlib
import math
import random

import comparison
import numpy as np
import pytest
from pyspark.sql import functions as F

from lodemark import plans
from lodemark.functions import scalars as X
from lodemark.operators import containment as C
from lodemark.operators import draws as D
from lodemark.operators import resampling as R


@pytest.mark.parametrize("sizes", [[1], [2, 3], [5, 7, 11], [64], [65], [3, 1, 4]])
def test_every_point_is_drawn_once(spark, sizes):
    """All numbers of the permuted range give each point of the space exactly once."""
    size = int(np.prod(sizes))
    got = [tuple(r)[1:] for r in D.draws(spark, sizes, 0, 4 ** D.half_bits(size), "s").collect()]
    assert len(got) == size == len(set(got)) and all(all(0 <= d < n for d, n in zip(g, sizes, strict=True)) for g in got)


def test_draws_of_a_huge_space_repeat_on_any_partitioning(spark):
    sizes = [10_000, 10_000, 10_000]
    one = D.draws(spark, sizes, 0, 3000, "a")
    rows = {tuple(r) for r in one.collect()}
    assert len({r[1:] for r in rows}) == len(rows) > 3000 / 5
    parts = {tuple(r) for lo in range(0, 3000, 500) for r in D.draws(spark, sizes, lo, lo + 500, "a").repartition(3).collect()}
    assert parts == rows and rows != {tuple(r) for r in D.draws(spark, sizes, 0, 3000, "b").collect()}
    means = np.array([r[1:] for r in rows]).mean(axis=0)
    assert (abs(means - 5000) < 500).all()
    assert D.draws(spark, [5, 0], 0, 9, "a").count() == 0
    with pytest.raises(ValueError):
        D.draws(spark, [2**30, 2**30], 0, 1, "a")


def plain_draw(i, sizes, seed):
    """The digits of one draw in whole numbers of any length, none if its image lies outside."""
    size, out = math.prod(sizes), []
    half = 1 << D.half_bits(size)
    left, right = divmod(i, half)
    for k in range(D.ROUNDS):
        left, right = right, left ^ int(hashlib.md5(f"{seed}:{k}:{right}".encode()).hexdigest()[: 8 if half <= 1 << 32 else 15], 16) % half
    v = left * half + right
    for n in reversed(sizes):
        v, d = divmod(v, n)
        out.append(d)
    return None if v else tuple(out[::-1])


@pytest.mark.parametrize("sizes", [[1_200_000, 60_000, 900_000], [7_200_000, 360_000, 5_400_000], [2**29 + 1, 2**29 + 3, 2**29 + 5], [2**29 - 1] * 4, [2**40, 3], [20_000, 1_000, 15_000]])
def test_draws_of_spaces_beyond_a_long(spark, sizes):
    want = {i: plain_draw(i, sizes, "7") for i in range(500)}
    assert {r[0]: tuple(r)[1:] for r in D.draws(spark, sizes, 0, 500, "7").collect()} == {i: d for i, d in want.items() if d}


def test_population_keeps_elites_and_moves_one_dimension(spark):
    sizes = [50, 1, 9]
    scored = D.draws(spark, sizes, 0, 200, "p").withColumn("fitness", F.col("d0") % 7)
    got = D.next_population(scored, D.draws(spark, sizes, 200, 230, "p"), sizes, 3, "p", elites=5, children=4).collect()
    best = sorted(scored.collect(), key=lambda r: (-r.fitness, r.i))[:5]
    parents = {r.i: (r.d0, r.d1, r.d2) for r in best}
    assert {r.i: (r.d0, r.d1, r.d2) for r in got if r.origin == "elite"} == parents
    kids = [r for r in got if r.origin == "child"]
    assert len(kids) == 20 and all(sum(a != b for a, b in zip((r.d0, r.d1, r.d2), parents[r.i], strict=True)) <= 1 for r in kids)
    assert any((r.d0, r.d1, r.d2) != parents[r.i] for r in kids) and all(r.d1 == 0 and r.d0 < 50 and r.d2 < 9 for r in kids)


def test_any_statistic_through_one_operator(spark):
    r = random.Random(4)
    rows = [(g, i, r.gauss(1 if g == "a" else 0, 1) if i % 9 else None) for g in "ab" for i in range(60)]
    df = spark.createDataFrame(rows, "g string, i int, x double").repartition(4)
    samples = {(s.g, s.it): s.sample for s in R.resampled(df, "g", "i", "x", 50, "7").collect()}
    values = {g: [x for k, _, x in rows if k == g and x is not None] for g in "ab"}
    assert len(samples) == 100 and all(len(s) == len(values[g]) and set(s) <= set(values[g]) for (g, _), s in samples.items())
    for f in (np.median, np.mean, lambda x: float(np.percentile(x, 90) - x.min())):
        got = {b.g: b for b in R.bootstrap(df, "g", "i", "x", f, 50).collect()}
        for g in "ab":
            each = [f(np.array(samples[g, i])) for i in range(50)]
            assert [got[g].low, got[g].mid, got[g].high] == pytest.approx(np.percentile(each, [2.5, 50, 97.5]).tolist())
            assert got[g].resamples == 50 and got[g].positive == np.mean(np.array(each) > 0)
    assert R.bootstrap(df, "g", "i", "x", lambda x: float("nan"), 5).filter("resamples > 0").count() == 0


def test_perturbations_stay_near_and_repeat(spark):
    df = spark.createDataFrame([(10.0, "a"), (-4.0, "b")], "p double, name string")
    got = R.perturbed(df, ["p"], 16, 0.1).collect()
    assert len(got) == 34 and {r.p for r in got if r.it == 0} == {10.0, -4.0}
    assert all(9.0 <= r.p <= 11.0 for r in got if r.name == "a") and len({r.p for r in got}) == 34
    assert {tuple(r) for r in R.perturbed(df.repartition(3), ["p"], 16, 0.1).collect()} == {tuple(r) for r in got}


def test_containment_equals_all_pairs(spark):
    r = random.Random(8)
    word = lambda n: "".join(r.choice("abc") for _ in range(n))
    needles = [(i, r.choice("xy"), word(r.randint(1, 7))) for i in range(60)] + [(60, "x", ""), (61, "x", None), (62, None, "a"), (63, "x", "aé漢")]
    texts = [(i, r.choice("xy"), word(r.randint(0, 30))) for i in range(60)] + [(60, "x", None), (61, "x", "bbaé漢c")]
    n, t = spark.createDataFrame(needles, "n long, g string, needle string"), spark.createDataFrame(texts, "t long, g string, text string")
    got = C.contained(n, t, "needle", "text", ["g"])
    assert sorted((x.n, x.t) for x in got.collect()) == sorted((a, b) for a, g, x in needles for b, h, y in texts if x and y and g == h and x in y)
    assert "NestedLoop" not in got._jdf.queryExecution().toString() and "CartesianProduct" not in got._jdf.queryExecution().toString()
    free = C.contained(n, t.drop("g"), "needle", "text")
    assert sorted((x.n, x.t) for x in free.collect()) == sorted((a, b) for a, _, x in needles for b, _, y in texts if x and y and x in y)
    assert C.contained(n.limit(0), t, "needle", "text", ["g"]).count() == 0


def test_a_symbol_without_a_cost_is_an_error(spark):
    df = spark.createDataFrame([("a",), ("z",)], "s string")
    assert df.filter("s = 'a'").select(X.round_trip_cost(F.col("s"), {"a": 0.5})).first()[0] == 0.5
    with pytest.raises(Exception, match="no cost is registered"):
        df.select(X.round_trip_cost(F.col("s"), {"a": 0.5})).collect()


def test_population_step_beyond_2_to_the_53(spark):
    """Elites and children of a space as large as the engine's 1 GB tables make it; scored is read once."""
    sizes, read = [1_200_000, 60_000, 900_000], spark.sparkContext.accumulator(0)

    def tally(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    drawn = D.draws(spark, sizes, 0, 2000, "p").withColumn("fitness", F.col("d1").cast("double"))
    scored = drawn.mapInArrow(tally, drawn.schema)
    got = D.next_population(scored, D.draws(spark, sizes, 2000, 2010, "p"), sizes, 2, "p", elites=5).collect()
    want = sorted(((-d[1], i, *d) for i in range(2000) if (d := plain_draw(i, sizes, "p"))))
    assert read.value == len(want)
    assert sorted(tuple(r)[1:] for r in got if r.origin == "elite") == sorted((i, 0, *d) for _, i, *d in want[:5])
    kids = [r for r in got if r.origin == "child"]
    best = {i: d for _, i, *d in want[:5]}
    assert len(kids) == 15 and all(sum(a != b for a, b in zip(tuple(r)[3:], best[r.i], strict=True)) == 1 for r in kids)


def test_evidence_joins_texts_not_copies(spark, sf_dir, tmp_path, monkeypatch):
    """Thirty copies of every part: as many texts are compared as without copies, and the answer is the SQL's."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet").limit(60)
    copies = part.withColumn("p_partkey", F.explode(F.transform(F.sequence(F.lit(0), F.lit(29)), lambda k: F.col("p_partkey") + k * 1_000_000)))
    copies.write.parquet(str(tmp_path / "parts"))
    spark.read.parquet(str(tmp_path / "parts")).toPandas().to_parquet(tmp_path / "part.parquet", index=False)
    seen, whole = [], C.contained
    monkeypatch.setattr(C, "contained", lambda a, b, *rest: seen.append(a.count() + b.count()) or whole(a, b, *rest))
    got = plans.queries()["triple_evidence"](spark, str(tmp_path))
    assert seen and max(seen) <= 60
    assert comparison.differences(got, plans.oracle_sql()["triple_evidence"], str(tmp_path)) == ""
