"""Queries of recurrent indicators; the oracles are recursive CTEs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import chains
from ..operators import recurrence as K
from ..sources import tables as T
from .base import BARS, TICKS
from .registry import query


def r6(x):
    return F.round(x, 6)


#: Numbered bars with the inputs of the smoothings; row 1 has no previous close.
_NUMBERED = f"""WITH RECURSIVE {BARS}, x AS (
  SELECT symbol, ts, high, low, close, row_number() OVER o AS r, close - lag(close) OVER o AS d,
         greatest(high - low, abs(high - lag(close) OVER o), abs(low - lag(close) OVER o)) AS tr,
         high - lag(high) OVER o AS up, lag(low) OVER o - low AS dn
  FROM bars WINDOW o AS (PARTITION BY symbol ORDER BY ts))"""


def ewm_sql(name, source, value, first, alpha):
    """A recursive CTE; columns of the source are written @name."""
    return f"""{name} AS (
  SELECT symbol, r, ({value.replace("@", "")})::DOUBLE AS y FROM {source} WHERE r = {first}
  UNION ALL SELECT s.symbol, s.r, {alpha} * ({value.replace("@", "s.")}) + (1 - {alpha}) * p.y FROM {name} p JOIN {source} s ON s.symbol = p.symbol AND s.r = p.r + 1)"""


@query(136, 139, 149, 142, sql=f"""{_NUMBERED}, {ewm_sql("e12", "x", "@close", 1, "(2.0 / 13)")}, {ewm_sql("e26", "x", "@close", 1, "(2.0 / 27)")},
{ewm_sql("e20", "x", "@close", 1, "(2.0 / 21)")}, {ewm_sql("a", "x", "@tr", 1, "(1.0 / 14)")},
m AS (SELECT e12.symbol, e12.r, e12.y - e26.y AS line FROM e12 JOIN e26 USING (symbol, r) WHERE e12.r >= 26), {ewm_sql("s", "m", "@line", 26, "(2.0 / 10)")}
SELECT symbol, ts, CASE WHEN r >= 20 THEN round(e20.y, 6) END AS ema_20, round(line, 6) AS macd, CASE WHEN r >= 34 THEN round(s.y, 6) END AS macd_signal,
  CASE WHEN r >= 34 THEN round(line - s.y, 6) END AS macd_hist, CASE WHEN r >= 14 THEN round(a.y, 6) END AS atr_14,
  CASE WHEN r >= 20 THEN round(e20.y - 2 * a.y, 6) END AS kc_low, CASE WHEN r >= 20 THEN round(e20.y + 2 * a.y, 6) END AS kc_high
FROM x JOIN e20 USING (symbol, r) JOIN a USING (symbol, r) LEFT JOIN m USING (symbol, r) LEFT JOIN s USING (symbol, r)""")
def ema_macd_atr_keltner(spark, sf_dir):
    def run(f):
        h, low, c = (f[x].to_numpy("f8") for x in ("high", "low", "close"))
        mid, a = K.ema(c, 20), K.atr(h, low, c, 14)
        line, sig, hist = K.macd(c)
        return {"ema_20": mid, "macd": line, "macd_signal": sig, "macd_hist": hist, "atr_14": a, "kc_low": mid - 2 * a, "kc_high": mid + 2 * a}

    names = ("ema_20", "macd", "macd_signal", "macd_hist", "atr_14", "kc_low", "kc_high")
    got = K.per_symbol(T.bars_1h(spark, sf_dir).select("symbol", "ts", "high", "low", "close"), run, dict.fromkeys(names, "double"))
    return got.select("symbol", "ts", *[r6(F.col(n)).alias(n) for n in names])


@query(138, 160, 159, 161, sql=f"""{_NUMBERED}, g AS (SELECT *, greatest(d, 0) AS gain, greatest(-d, 0) AS loss FROM x),
{ewm_sql("ug", "g", "@gain", 2, "(1.0 / 14)")}, {ewm_sql("ul", "g", "@loss", 2, "(1.0 / 14)")},
sg AS (SELECT symbol, 15::BIGINT AS r, avg(gain) AS y FROM g WHERE r BETWEEN 2 AND 15 GROUP BY symbol
  UNION ALL SELECT s.symbol, s.r, (p.y * 13 + s.gain) / 14 FROM sg p JOIN g s ON s.symbol = p.symbol AND s.r = p.r + 1),
sl AS (SELECT symbol, 15::BIGINT AS r, avg(loss) AS y FROM g WHERE r BETWEEN 2 AND 15 GROUP BY symbol
  UNION ALL SELECT s.symbol, s.r, (p.y * 13 + s.loss) / 14 FROM sl p JOIN g s ON s.symbol = p.symbol AND s.r = p.r + 1),
sa AS (SELECT symbol, 14::BIGINT AS r, avg(tr) AS y FROM g WHERE r <= 14 GROUP BY symbol
  UNION ALL SELECT s.symbol, s.r, (p.y * 13 + s.tr) / 14 FROM sa p JOIN g s ON s.symbol = p.symbol AND s.r = p.r + 1)
SELECT symbol, ts, CASE WHEN r >= 15 THEN round(CASE WHEN ul.y = 0 THEN CASE WHEN ug.y = 0 THEN 50 ELSE 100 END ELSE 100 - 100 / (1 + ug.y / ul.y) END, 6) END AS rsi_14,
  round(CASE WHEN sl.y = 0 THEN CASE WHEN sg.y = 0 THEN 50 ELSE 100 END ELSE 100 - 100 / (1 + sg.y / sl.y) END, 6) AS seeded_rsi_14, round(sa.y, 6) AS seeded_atr_14
FROM x LEFT JOIN ug USING (symbol, r) LEFT JOIN ul USING (symbol, r) LEFT JOIN sg USING (symbol, r) LEFT JOIN sl USING (symbol, r) LEFT JOIN sa USING (symbol, r)""")
def rsi_plain_and_seeded(spark, sf_dir):
    def run(f):
        h, low, c = (f[x].to_numpy("f8") for x in ("high", "low", "close"))
        return {"rsi_14": K.rsi(c, 14), "seeded_rsi_14": K.seeded_rsi(c), "seeded_atr_14": K.seeded(K.true_range(h, low, c), 14)}

    names = ("rsi_14", "seeded_rsi_14", "seeded_atr_14")
    got = K.per_symbol(T.bars_1h(spark, sf_dir).select("symbol", "ts", "high", "low", "close"), run, dict.fromkeys(names, "double"))
    return got.select("symbol", "ts", *[r6(F.col(n)).alias(n) for n in names])


@query(143, 196, sql=f"""{_NUMBERED}, g AS (SELECT *, CASE WHEN up > dn AND up > 0 THEN up ELSE 0 END AS pdm, CASE WHEN dn > up AND dn > 0 THEN dn ELSE 0 END AS mdm FROM x),
{ewm_sql("a", "g", "@tr", 1, "(1.0 / 14)")}, {ewm_sql("p", "g", "@pdm", 1, "(1.0 / 14)")}, {ewm_sql("m", "g", "@mdm", 1, "(1.0 / 14)")},
di AS (SELECT symbol, r, 100 * p.y / a.y AS pdi, 100 * m.y / a.y AS mdi, 100 * abs(p.y - m.y) / nullif(p.y + m.y, 0) AS dx
  FROM a JOIN p USING (symbol, r) JOIN m USING (symbol, r) WHERE r >= 14), {ewm_sql("adx", "di", "@dx", 14, "(1.0 / 14)")}
SELECT symbol, ts, round(pdi, 6) AS plus_di, round(mdi, 6) AS minus_di, CASE WHEN r >= 27 THEN round(adx.y, 6) END AS adx_14,
  CASE WHEN r >= 27 THEN CASE WHEN adx.y >= 25 THEN 'TRENDING' ELSE 'RANGING' END END AS regime
FROM x LEFT JOIN di USING (symbol, r) LEFT JOIN adx USING (symbol, r)""")
def adx_and_regime(spark, sf_dir):
    def run(f):
        a, p, m = K.adx(*(f[x].to_numpy("f8") for x in ("high", "low", "close")))
        return {"adx_14": a, "plus_di": p, "minus_di": m}

    got = K.per_symbol(T.bars_1h(spark, sf_dir).select("symbol", "ts", "high", "low", "close"), run, dict.fromkeys(("adx_14", "plus_di", "minus_di"), "double"))
    regime = F.when(F.col("adx_14") >= 25, "TRENDING").when(F.col("adx_14").isNotNull(), "RANGING")
    return got.select("symbol", "ts", r6(F.col("plus_di")).alias("plus_di"), r6(F.col("minus_di")).alias("minus_di"), r6(F.col("adx_14")).alias("adx_14"), regime.alias("regime"))


@query(152, sql=f"""{_NUMBERED}, {ewm_sql("a10", "x", "@tr", 1, "(1.0 / 10)")}, sx AS (SELECT symbol, r, (high + low) / 2 AS mid, close, a10.y FROM x JOIN a10 USING (symbol, r) WHERE r >= 10),
st AS (SELECT symbol, r, mid + 3 * y AS top, mid - 3 * y AS bottom, 1 AS way, close FROM sx WHERE r = 10
  UNION ALL SELECT s.symbol, s.r, CASE WHEN p.close <= p.top THEN least(s.mid + 3 * s.y, p.top) ELSE s.mid + 3 * s.y END, CASE WHEN p.close >= p.bottom THEN greatest(s.mid - 3 * s.y, p.bottom) ELSE s.mid - 3 * s.y END,
    CASE WHEN s.close > p.top THEN 1 WHEN s.close < p.bottom THEN -1 ELSE p.way END, s.close FROM st p JOIN sx s ON s.symbol = p.symbol AND s.r = p.r + 1)
SELECT symbol, ts, round(CASE WHEN way > 0 THEN bottom ELSE top END, 6) AS line, coalesce(way, 1) AS direction FROM x LEFT JOIN st USING (symbol, r)""")
def supertrend_line(spark, sf_dir):
    def run(f):
        line, way = K.supertrend(*(f[x].to_numpy("f8") for x in ("high", "low", "close")))
        return {"line": line, "direction": way}

    got = K.per_symbol(T.bars_1h(spark, sf_dir).select("symbol", "ts", "high", "low", "close"), run, {"line": "double", "direction": "long"})
    return got.select("symbol", "ts", r6(F.col("line")).alias("line"), "direction")


_T = f"""WITH RECURSIVE {TICKS}, x AS (SELECT symbol, seq, ts, row_number() OVER (PARTITION BY symbol ORDER BY ts, seq) AS r FROM ticks)"""


@query(374, sql=f"""{_T}, t AS (SELECT symbol, r, ts AS last, true AS sent FROM x WHERE r = 1
  UNION ALL SELECT x.symbol, x.r, CASE WHEN x.ts >= t.last + INTERVAL 30 MINUTE THEN x.ts ELSE t.last END, x.ts >= t.last + INTERVAL 30 MINUTE
  FROM t JOIN x ON x.symbol = t.symbol AND x.r = t.r + 1)
SELECT symbol, seq, ts, sent FROM x JOIN t USING (symbol, r)""")
def publish_throttle(spark, sf_dir):
    """The first tick of a symbol, then always the first at least half an hour after the last one let through. Each tick points at the
    next that would be; the chain from the first is followed by doubling, so no series gathers in a task."""
    rows = T.ticks(spark, sf_dir).select("symbol", "ts", "seq")
    sent = chains.spaced(rows, "symbol", "ts", "seq", 1800)
    return rows.join(sent.withColumn("sent", F.lit(True)), ["symbol", "seq"], "left").select("symbol", "seq", "ts", F.coalesce("sent", F.lit(False)).alias("sent"))


@query(55, sql=f"""WITH RECURSIVE {TICKS}, x AS (SELECT user_id, seq, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, seq) AS r FROM ticks),
t AS (SELECT user_id, r, [ts] AS log, true AS accepted FROM x WHERE r = 1
  UNION ALL SELECT x.user_id, x.r, CASE WHEN len(list_filter(t.log, lambda a: a > x.ts - INTERVAL 6 HOUR)) < 3 THEN list_append(list_filter(t.log, lambda a: a > x.ts - INTERVAL 6 HOUR), x.ts) ELSE t.log END,
    len(list_filter(t.log, lambda a: a > x.ts - INTERVAL 6 HOUR)) < 3 FROM t JOIN x ON x.user_id = t.user_id AND x.r = t.r + 1)
SELECT user_id, seq, ts, accepted FROM x JOIN t USING (user_id, r)""")
def sliding_rate_limit(spark, sf_dir):
    """At most 3 accepted hits of a user in 6 hours; rejected hits are not recorded, which a plain range count would get wrong. Users are
    streamed one after another, with three times kept."""
    return K.sliding_limits(T.ticks(spark, sf_dir).select("user_id", "seq", "ts"), "user_id", 3, 6 * 3600, ("ts", "seq"))


_EV = f"""WITH RECURSIVE {BARS}, b AS (SELECT *, row_number() OVER o - 1 AS i, count(*) OVER (PARTITION BY symbol) AS len, lag(close) OVER o AS p FROM bars WINDOW o AS (PARTITION BY symbol ORDER BY ts)),
ev AS (SELECT symbol, i, row_number() OVER (PARTITION BY symbol ORDER BY i) AS k FROM b WHERE close > p * 1.5 AND i + 6 < len)"""


@query(205, 206, sql=f"""{_EV}, t AS (SELECT symbol, k, i, true AS taken, i + 6 AS free FROM ev WHERE k = 1
  UNION ALL SELECT e.symbol, e.k, e.i, e.i >= t.free, CASE WHEN e.i >= t.free THEN e.i + 6 ELSE t.free END FROM t JOIN ev e ON e.symbol = t.symbol AND e.k = t.k + 1)
SELECT t.symbol, b.ts AS entry_ts, x.ts AS exit_ts, round(x.close / b.close - 1 - 0.00085, 6) AS net
FROM t JOIN b ON b.symbol = t.symbol AND b.i = t.i JOIN b x ON x.symbol = t.symbol AND x.i = t.i + 6 WHERE taken""")
def non_overlapping_trades(spark, sf_dir):
    """Greedy selection of holding windows: an event inside one is skipped, and so is one whose exit lies past the end."""
    from ..functions import rolling as R

    w = R.series("symbol")
    close = F.col("close")
    b = T.bars_1h(spark, sf_dir).select("symbol", "ts", "close", (close > F.lag(close).over(w) * 1.5).alias("event"))
    b = b.withColumns({"exit_ts": F.lead("ts", 6).over(w), "exit": F.lead("close", 6).over(w)})

    def run(f):
        import numpy as np

        taken = np.zeros(len(f), dtype=bool)
        taken[K.non_overlapping(np.flatnonzero(f["event"].eq(True).to_numpy(bool)), 6, len(f))] = True
        return {"taken": taken}

    got = K.per_symbol(b, run, {"taken": "boolean"}).filter("taken")
    return got.select("symbol", F.col("ts").alias("entry_ts"), "exit_ts", r6(F.col("exit") / close - 1 - 0.00085).alias("net"))
