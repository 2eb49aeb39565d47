"""Decisions that depend on earlier decisions, without passing over them one by one.

Novelty: an item is kept unless it shares a key with an item kept before it (a
key may stand for an edge of a similarity graph or for a signature). Each round
keeps every undecided item that comes first under all its keys, and drops what
shares a key with a kept one: the result is that of the sequential pass, and no
task sees more of a key than a partial minimum.

Authorisation: within a period at most a few decisions are ever accepted, and
the next one is the first that fits the state left by those before it, so there
are as many rounds as decisions that one period accepts. The reason of every
other decision follows from what was accepted before it.

Lifecycle: entities of up to MANY evaluations are streamed one after another. Of
others, an evaluation maps a state (phase, good runs, days in the phase) to a
state. A bucket of evaluations is such a map, worked out for all states at once,
and maps of neighbouring buckets are composed by doubling; so an entity with any
number of evaluations is spread over its buckets.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .chains import cut_lineage
from .recurrence import in_turn

SMALL = 100_000


def greedy_novel(items: DataFrame, rank: str, keys: str) -> DataFrame:
    """Adds kept. rank is unique; the least comes first. An item without keys is kept."""
    at = items.select(F.col(rank).alias("_r"), F.array_distinct(F.coalesce(keys, F.array().cast("array<string>"))).alias("_k"))
    left = cut_lineage(at.filter(F.size("_k") > 0).select("_r", F.explode("_k").alias("_k")))
    dropped = left.select("_r").limit(0)
    while not left.isEmpty():
        heads = left.groupBy("_k").agg(F.min("_r").alias("_head"))
        first = left.join(heads, "_k").groupBy("_r").agg(F.bool_and(F.col("_r") == F.col("_head")).alias("first"))
        kept = cut_lineage(first.filter("first").select(F.col("_r").alias("_w")))
        taken = left.join(kept, F.col("_r") == F.col("_w"), "left_semi").select("_k").distinct()
        gone = cut_lineage(left.join(taken, "_k", "left_semi").select("_r").distinct())  # the kept ones among them
        dropped = cut_lineage(dropped.unionByName(gone.join(kept, F.col("_r") == F.col("_w"), "left_anti")))
        left = cut_lineage(left.join(gone, "_r", "left_anti"))
    return items.join(dropped.withColumn("_gone", F.lit(True)), F.col(rank) == F.col("_r"), "left").withColumn("kept", F.col("_gone").isNull()).drop("_r", "_gone")


@dataclass(frozen=True)
class Limits:
    """In units of the amount: all of a period's, one decision's; how many decisions, and from how many on they count as correlated."""

    total: int
    each: int
    positions: int = 5
    crowd: int = 3


def _refusal(held: Column, amount: Column, limits: Limits) -> Column:
    """Why a decision does not fit beside those held, or null."""
    total = F.aggregate(held, F.lit(0).cast("long"), lambda a, x: a + x["amount"])
    return (
        F.when(total + amount > limits.total, "TOTAL_ALLOCATION").when(amount > limits.each, "PER_STRATEGY")
        .when(F.size(held) >= limits.positions, "POSITIONS").when(F.size(held) >= limits.crowd, "CORRELATION")
    )


def authorise(decisions: DataFrame, period: str, order: str, amount: str, asks: Column, limits: Limits) -> DataFrame:
    """Adds reason: null where a decision is allowed. Rows that do not ask are allowed and hold nothing; order is unique in a period."""
    none = F.array().cast("array<struct<ord:bigint,amount:bigint>>")
    rows = decisions.withColumns({"_p": F.col(period), "_o": F.col(order).cast("long"), "_a": F.col(amount).cast("long"), "_asks": F.coalesce(asks, F.lit(False))})
    open_ = cut_lineage(rows.filter("_asks").select("_p", "_o", "_a"))
    held = cut_lineage(open_.select("_p").limit(0).withColumn("_held", none))
    while True:
        side = F.broadcast(held) if held.count() <= SMALL else held  # a row a period
        met = open_.join(side.withColumnRenamed("_p", "_q"), F.col("_p").eqNullSafe(F.col("_q")), "left").withColumn("_held", F.coalesce("_held", none))
        last = F.coalesce(F.get("_held", F.size("_held") - 1)["ord"], F.lit(-(2**63)).cast("long"))
        fits = met.filter((F.col("_o") > last) & _refusal(F.col("_held"), F.col("_a"), limits).isNull())
        new = cut_lineage(fits.groupBy("_p").agg(F.min_by(F.struct(F.col("_o").alias("ord"), F.col("_a").alias("amount")), "_o").alias("_new")))
        if new.isEmpty():
            break
        both = held.join(new.withColumnRenamed("_p", "_q"), F.col("_p").eqNullSafe(F.col("_q")), "full")
        held = cut_lineage(both.select(F.coalesce("_p", "_q").alias("_p"), F.concat(F.coalesce("_held", none), F.when(F.col("_new").isNull(), none).otherwise(F.array("_new"))).alias("_held")))
    side = F.broadcast(held) if held.count() <= SMALL else held
    met = rows.join(side.withColumnRenamed("_p", "_q"), F.col("_p").eqNullSafe(F.col("_q")), "left")
    before = F.filter(F.coalesce("_held", none), lambda x: x["ord"] < F.col("_o"))
    return met.withColumn("reason", F.when(F.col("_asks"), _refusal(before, F.col("_a"), limits))).drop("_p", "_o", "_a", "_asks", "_q", "_held")


ACTIVE, DEGRADED, PAUSED, RETIRED = range(4)
PHASES = ("ACTIVE", "DEGRADED", "PAUSED", "RETIRED")


@dataclass(frozen=True)
class Policy:
    """Thresholds of the lifecycle; days are whole."""

    degraded: float = 0.5
    paused: float = 0.0
    recovery: float = 0.75
    trades: int = 30
    drawdown: float = 0.5
    dwell: int = 1
    retire: int = 90

    @property
    def ages(self) -> int:
        """Days in a phase that can make a difference, the last standing for all more."""
        return max(self.dwell, self.retire) + 1


_MAP = "array<struct<to:int,since:int,g0:boolean,g:long,b0:boolean,b:long,moves:long>>"


def bucket_map(events: pd.DataFrame, start: int, length: int, policy: Policy) -> list[dict]:
    """Where every state at `start` leads by `start + length`. events: day, sharpe, trades, dd, first, in order. The good and bad runs are
    what comes on top of the state's own unless they were reset; since is the day of the last change, if there was one."""
    n = policy.ages
    at = np.arange(4 * 3 * n)
    phase, runs, age, prev = at // (3 * n), at // n % 3, at % n, start
    since, moves = np.full(len(at), np.iinfo("i4").min), np.zeros(len(at), "i8")
    g0, b0, g, b = np.zeros(len(at), bool), np.zeros(len(at), bool), np.zeros(len(at), "i8"), np.zeros(len(at), "i8")
    for day, sharpe, trades, dd, first in events[["day", "sharpe", "trades", "dd", "first"]].itertuples(index=False):
        age, prev = np.minimum(age + (day - prev), n - 1), day
        if first:  # the entity is registered
            phase, runs, age = np.full_like(at, ACTIVE), np.zeros_like(at), np.zeros_like(at)
            since[:], g0[:], b0[:], g[:], b[:] = day, True, True, 0, 0
        judged = (phase != RETIRED) & ~((phase == ACTIVE) & (trades < policy.trades))
        if sharpe >= policy.recovery:
            runs, g = np.where(judged, np.minimum(runs + 1, 2), runs), g + judged
            b0, b = b0 | judged, np.where(judged, 0, b)
        elif sharpe < policy.degraded:
            runs, b = np.where(judged, 0, runs), b + judged
            g0, g = g0 | judged, np.where(judged, 0, g)
        good, up = sharpe >= policy.recovery, np.select([phase == DEGRADED, phase == PAUSED], [ACTIVE, DEGRADED], phase)
        target = np.where(good & (runs >= 2), up, np.where((phase == PAUSED) & (age >= policy.retire), RETIRED, phase))
        trading = (phase == ACTIVE) | (phase == DEGRADED)
        if sharpe < policy.paused or dd >= policy.drawdown:
            target = np.where(trading, PAUSED, target)
        elif sharpe < policy.degraded:
            target = np.where(phase == ACTIVE, DEGRADED, target)
        move = judged & (target != phase) & (age >= policy.dwell)
        phase, age, runs = np.where(move, target, phase), np.where(move, 0, age), np.where(move, 0, runs)
        since, moves = np.where(move, day, since), moves + move
        g0, b0, g, b = g0 | move, b0 | move, np.where(move, 0, g), np.where(move, 0, b)
    age = np.minimum(age + (start + length - prev), n - 1)
    to = (phase * 3 + runs) * n + age
    rows = zip(*(x.tolist() for x in (to, since, g0, g, b0, b, moves)), strict=True)
    return [{"to": t, "since": None if s == np.iinfo("i4").min else s, "g0": p, "g": q, "b0": r, "b": u, "moves": v} for t, s, p, q, r, u, v in rows]


def _shift(state: Column, days: Column, ages: int) -> Column:
    """The same state some days later."""
    return (state - state % ages + F.least(state % ages + days, F.lit(ages - 1))).cast("int")


def _then(x: Column, y: Column) -> Column:
    """One entry after another."""
    add = lambda reset, n: F.when(y[reset], y[n]).otherwise(x[n] + y[n]).alias(n)
    return F.struct(y["to"].alias("to"), F.coalesce(y["since"], x["since"]).alias("since"), (x["g0"] | y["g0"]).alias("g0"), add("g0", "g"), (x["b0"] | y["b0"]).alias("b0"), add("b0", "b"), (x["moves"] + y["moves"]).alias("moves"))


#: Most evaluations of an entity that one task takes in turn.
MANY = 10_000


def lifecycle(evaluations: DataFrame, by: str, day: str, policy: Policy = Policy(), length: int = 7, many: int = MANY) -> DataFrame:
    """Of each entity its phase, the day since when, runs, changes, evaluations and best Sharpe after all its evaluations.
    evaluations: by, day (int), seq (order within a day), sharpe, trades, dd, none null; length: days of a bucket; many: evaluations
    beyond which an entity is spread over buckets."""
    rows = evaluations.select(F.col(by).alias("_by"), F.col(day).cast("int").alias("day"), "seq", F.col("sharpe").cast("double"), F.col("trades").cast("long"), F.col("dd").cast("double"))
    rows = cut_lineage(rows.filter(F.col("_by").isNotNull()))
    sums = cut_lineage(rows.groupBy("_by").agg(F.count("*").alias("evaluations"), F.max("sharpe").alias("best_sharpe")))
    long_ = sums.filter(F.col("evaluations") > many).select("_by")
    if long_.isEmpty():
        got = _in_turn(rows, policy)
    else:
        got = _in_turn(rows.join(long_, "_by", "left_anti"), policy).unionByName(_by_buckets(rows.join(long_, "_by", "left_semi"), policy, length))
    return got.join(sums, "_by").withColumnRenamed("_by", by)


def _in_turn(rows: DataFrame, policy: Policy) -> DataFrame:
    """The last state of each entity by the sequential pass."""
    fields = rows.select("_by", F.lit("").alias("phase"), F.col("day").alias("since"), *[F.lit(0).cast("long").alias(c) for c in ("good_runs", "bad_runs", "moves")]).schema
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in fields])

    def run(batches):
        key, state, moves = None, None, 0
        for batch in batches:
            done = []
            columns = [batch.column(c).to_pylist() for c in ("_by", "day", "sharpe", "trades", "dd")]
            for k, *event in zip(*columns, strict=True):
                if k != key:
                    if state:
                        done.append((key, *state, moves))
                    key, state, moves = k, ("ACTIVE", event[0], 0, 0), 0
                new = advance(*state, *event, policy)
                moves += new[0] != state[0]
                state = new
            yield table(done)
        if state:
            yield table([(key, *state, moves)])

    arrow = to_arrow_schema(schema)

    def table(done):
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], f.type) for i, f in enumerate(arrow)], schema=arrow)

    return in_turn(rows, "_by", ("day", "seq"), run, schema)


def _by_buckets(rows: DataFrame, policy: Policy, length: int) -> DataFrame:
    """The last state of each entity from maps of its buckets."""
    origin, last = rows.agg(F.min("day"), F.max("day")).first()
    n = policy.ages
    one = F.row_number().over(Window.partitionBy("_by", "_k").orderBy("day", "seq"))
    rows = rows.withColumn("_k", F.floor((F.col("day") - origin) / length).cast("int"))
    begun = rows.groupBy("_by").agg(F.min(F.struct("day", "seq")).alias("_first"))
    rows = rows.join(begun, "_by").withColumn("first", F.struct("day", "seq") == F.col("_first")).withColumn("_i", one)
    kind = rows.schema["_by"].dataType.simpleString()

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("_i")
        k = int(frame["_k"].iloc[0])
        return pd.DataFrame({"_by": frame["_by"].iloc[:1].to_numpy(), "_k": [k], "map": [bucket_map(frame, origin + k * length, length, policy)]})

    maps = cut_lineage(rows.groupBy("_by", "_k").applyInPandas(run, f"_by {kind}, _k int, map {_MAP}"))
    span = length
    while origin + span <= last:  # until one bucket holds all days
        half = lambda r: F.max(F.when(F.pmod("_k", F.lit(2)) == r, F.col("map")))  # noqa: E731  one row each
        pair = maps.groupBy("_by", F.floor(F.col("_k") / 2).cast("int").alias("_k")).agg(half(0).alias("a"), half(1).alias("b"))
        empty = F.transform(F.sequence(F.lit(0), F.lit(12 * n - 1)), lambda i: F.struct(_shift(i, F.lit(span), n).alias("to"), F.lit(None).cast("int").alias("since"), F.lit(False).alias("g0"), F.lit(0).cast("long").alias("g"), F.lit(False).alias("b0"), F.lit(0).cast("long").alias("b"), F.lit(0).cast("long").alias("moves")))
        pair = pair.select("_by", "_k", F.coalesce("a", empty).alias("a"), F.coalesce("b", empty).alias("b"))
        maps = cut_lineage(pair.select("_by", "_k", F.transform("a", lambda x: _then(x, F.get(F.col("b"), x["to"]))).cast(_MAP).alias("map")))
        span *= 2
    end = F.get("map", F.lit(0))  # any state will do: the first evaluation sets it
    phase = F.get(F.array(*map(F.lit, PHASES)), F.floor(end["to"] / (3 * n)).cast("int"))
    return maps.select("_by", phase.alias("phase"), end["since"].alias("since"), end["g"].alias("good_runs"), end["b"].alias("bad_runs"), end["moves"].alias("moves"))


def advance(phase: str, since: int, good: int, bad: int, day: int, sharpe: float, trades: int, dd: float, policy: Policy) -> tuple[str, int, int, int]:
    """One evaluation of the sequential pass."""
    if phase == "RETIRED" or (phase == "ACTIVE" and trades < policy.trades):
        return phase, since, good, bad
    if sharpe >= policy.recovery:
        good, bad = good + 1, 0
    elif sharpe < policy.degraded:
        good, bad = 0, bad + 1
    back = sharpe >= policy.recovery and good >= 2
    target = phase
    if phase != "PAUSED" and (sharpe < policy.paused or dd >= policy.drawdown):
        target = "PAUSED"
    elif phase == "ACTIVE" and sharpe < policy.degraded:
        target = "DEGRADED"
    elif phase == "DEGRADED" and back:
        target = "ACTIVE"
    elif phase == "PAUSED":
        target = "DEGRADED" if back else "RETIRED" if day - since >= policy.retire else "PAUSED"
    return (target, day, 0, 0) if target != phase and day - since >= policy.dwell else (phase, since, good, bad)


def replay(events: list[tuple[int, float, int, float]], policy: Policy) -> Iterator[tuple[str, int, int, int]]:
    """The plain sequential pass over one entity's (day, sharpe, trades, dd): (phase, since, good, bad) after each."""
    phase, since, good, bad = "ACTIVE", events[0][0] if events else 0, 0, 0
    for event in events:
        phase, since, good, bad = advance(phase, since, good, bad, *event, policy)
        yield phase, since, good, bad
