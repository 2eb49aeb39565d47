"""Walk-forward queries: parameters chosen in each fold, and a model's out-of-sample probabilities."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import folds as FO
from ..operators import models as M
from ..sources import tables as T
from .base import BARS
from .registry import query

#: Look-back bars of the momentum rule, and bars of a fold's slices.
LOOKBACKS, TRAIN, TEST = (3, 6, 12, 24, 48), 200, 50

_FOLDS = f"""{BARS}, r AS (SELECT symbol, close, row_number() OVER w - 1 AS pos, count(*) OVER (PARTITION BY symbol) AS len, ln(lead(close) OVER w / close) AS fwd,
  {", ".join(f"sign(close - lag(close, {k}) OVER w) AS s{k}" for k in LOOKBACKS)} FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
x AS ({" UNION ALL ".join(f"SELECT symbol, pos, {k} AS lookback, s{k} * fwd AS x FROM r WHERE s{k} <> 0 AND fwd IS NOT NULL" for k in LOOKBACKS)}),
f AS (SELECT symbol, start, start // {TEST} + 1 AS fold FROM (SELECT symbol, unnest(range(0, max(len) - {TRAIN + TEST} + 1, {TEST})) AS start FROM r GROUP BY symbol)),
m AS (SELECT symbol, fold, start, lookback, count(x) FILTER (pos < start + {TRAIN} - 1) AS train_n, count(x) FILTER (pos >= start + {TRAIN} AND pos < start + {TRAIN + TEST} - 1) AS test_n,
  coalesce(round(CASE WHEN stddev_samp(x) FILTER (pos < start + {TRAIN} - 1) > 1e-9 THEN avg(x) FILTER (pos < start + {TRAIN} - 1) / stddev_samp(x) FILTER (pos < start + {TRAIN} - 1) END, 9), 0) AS train_sr,
  coalesce(round(CASE WHEN stddev_samp(x) FILTER (pos >= start + {TRAIN} AND pos < start + {TRAIN + TEST} - 1) > 1e-9 THEN avg(x) FILTER (pos >= start + {TRAIN} AND pos < start + {TRAIN + TEST} - 1) / stddev_samp(x) FILTER (pos >= start + {TRAIN} AND pos < start + {TRAIN + TEST} - 1) END, 9), 0) AS test_sr,
  round(coalesce(sum(x) FILTER (pos >= start + {TRAIN} AND pos < start + {TRAIN + TEST} - 1), 0), 9) AS test_sum
  FROM f JOIN x USING (symbol) WHERE pos >= start AND pos < start + {TRAIN + TEST} - 1 GROUP BY ALL),
c AS (SELECT *, row_number() OVER (PARTITION BY symbol, fold ORDER BY train_sr DESC, lookback) AS k FROM m WHERE train_n >= 3)"""


def momentum_returns(bars):
    """(symbol, pos, lookback, x): the next bar's log return in the direction of the momentum, for every look-back; null without one."""
    w = Window.partitionBy("symbol").orderBy("ts")
    c = F.col("close")
    ahead = F.ln(F.lead(c).over(w) / c)
    each = F.array(*[F.struct(F.lit(k).alias("lookback"), F.signum(c - F.lag(c, k).over(w)).alias("side")) for k in LOOKBACKS])
    r = bars.select("symbol", (F.row_number().over(w) - 1).alias("pos"), ahead.alias("ahead"), each.alias("each"))
    r = r.select("symbol", "pos", "ahead", F.inline("each"))
    return r.select("symbol", "pos", "lookback", F.when(F.col("side") != 0, F.col("side") * F.col("ahead")).alias("x"))


def chosen_per_fold(bars):
    lengths = bars.groupBy("symbol").agg(F.count("*").alias("len"))
    folds = FO.windows(lengths, "len", TRAIN, TEST, TEST)
    return FO.best(FO.scored(momentum_returns(bars), folds, "symbol", "lookback", "pos", "x"), "symbol", "lookback")


@query(207, 309, sql=f"WITH {_FOLDS} SELECT symbol, fold, start, start + {TRAIN} AS train_end, start + {TRAIN + TEST} AS test_end, lookback, train_n, train_sr, test_n, test_sr, test_sum FROM c WHERE k = 1")
def best_params_per_fold(spark, sf_dir):
    """The look-back of highest train Sharpe in each fold, and what it gives in the fold's test slice."""
    return chosen_per_fold(T.bars_1h(spark, sf_dir))


@query(309, sql=f"""WITH {_FOLDS} SELECT symbol, count(*) AS folds, round(avg(train_sr), 6) AS mean_train, round(avg(test_sr), 6) AS mean_test,
round(CASE WHEN avg(abs(train_sr)) > 1e-9 THEN avg(test_sr) / avg(abs(train_sr)) ELSE 0 END, 6) AS efficiency, round(avg((test_sr > 0)::INT), 6) AS consistency, sum(test_n)::BIGINT AS test_trades FROM c WHERE k = 1 GROUP BY symbol""")
def walk_forward_report(spark, sf_dir):
    return FO.report(chosen_per_fold(T.bars_1h(spark, sf_dir)), "symbol")


@query(310, 311, sql=f"""WITH {BARS}, n AS (SELECT symbol, count(*) AS len FROM bars GROUP BY symbol), s AS (SELECT symbol, len, unnest(range(0, len - 400, 50)) AS start FROM n)
SELECT symbol, (start // 50 + 1)::INT AS fold, start::INT AS start, (start + 300)::INT AS train_end, (start + 400)::INT AS test_end FROM s""")
def walk_forward_bounds(spark, sf_dir):
    """Window bounds of every series from its length; starts end before the last one that would fit."""
    n = T.bars_1h(spark, sf_dir).groupBy("symbol").agg(F.count("*").alias("len"))
    return FO.windows(n, "len", 300, 100, 50, inclusive=False).select("symbol", "fold", "start", "train_end", "test_end")


def model_rows(bars):
    """Bars with position, features of the past, and whether the next bar closes higher."""
    w = Window.partitionBy("symbol").orderBy("ts")
    c = F.col("close")
    r = bars.withColumns({"pos": F.row_number().over(w) - 1, "ret": F.ln(c / F.lag(c).over(w)), "label": (F.lead(c).over(w) > c).cast("int")})
    near = w.rowsBetween(-23, 0)
    return r.select(
        "symbol", "ts", "pos", "label", "ret", F.ln(c / F.lag(c, 6).over(w)).alias("momentum_6"), F.ln(c / F.lag(c, 24).over(w)).alias("momentum_24"),
        F.when(F.count("ret").over(near) == 24, F.stddev_samp("ret").over(near)).alias("volatility"), ((F.col("high") - F.col("low")) / c).alias("span"),
    )


@query(339, 340)
def oos_predictions(spark, sf_dir):
    """A forest for each window of all series, trained on what lies before its test slice; features need 24 bars before they are valid."""
    rows = model_rows(T.bars_1h(spark, sf_dir))
    longest = (rows.agg(F.max("pos")).first()[0] or 0) + 1
    whole = 400 if longest >= 500 else max(longest // 3, 60)  # short histories have shorter windows, of the same shares
    train, test = whole - whole // 4, whole // 4
    bounds = [(s, s + train, s + whole) for s in range(0, longest - whole + 1, test)]
    got = M.oos_probabilities(rows, ["ret", "momentum_6", "momentum_24", "volatility", "span"], "label", "pos", bounds, warm_up=24)
    return got.select("symbol", "ts", "window", "label", F.round("probability", 9).alias("probability"))
