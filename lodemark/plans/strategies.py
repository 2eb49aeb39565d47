"""Queries of trading rules on hourly bars; recurrent ones have recursive CTEs as oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import strategies as G
from ..sources import tables as T
from .base import BARS
from .recurrent import _NUMBERED, ewm_sql
from .registry import query


def _w(n: int, upto: str = "CURRENT ROW", first: int | None = None) -> str:
    return f"(PARTITION BY symbol ORDER BY ts ROWS BETWEEN {n - 1 if first is None else first} PRECEDING AND {upto})"


_HOLD = "coalesce(last_value(nullif({0}, 0) IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING), 0)"


@query(360, 361, 362, 363, 366, 367, sql=f"""WITH {BARS}, a AS (SELECT symbol, ts, close, (high + low + close) / 3 AS tp, row_number() OVER o AS r,
  CASE WHEN count(*) OVER w26 = 26 THEN 4.0 * (list_position(list(high) OVER w26, max(high) OVER w26) - list_position(list(low) OVER w26, min(low) OVER w26)) END AS osc,
  CASE WHEN count(*) OVER w14 = 14 THEN 100 * (close - min(low) OVER w14) / nullif(max(high) OVER w14 - min(low) OVER w14, 0) END AS raw,
  CASE WHEN count(*) OVER p20 = 20 THEN max(high) OVER p20 END AS eu, CASE WHEN count(*) OVER p20 = 20 THEN min(low) OVER p20 END AS el,
  CASE WHEN count(*) OVER p10 = 10 THEN max(high) OVER p10 END AS xu, CASE WHEN count(*) OVER p10 = 10 THEN min(low) OVER p10 END AS xl,
  CASE WHEN count(*) OVER w9 = 9 THEN (max(high) OVER w9 + min(low) OVER w9) / 2 END AS tenkan, CASE WHEN count(*) OVER w26 = 26 THEN (max(high) OVER w26 + min(low) OVER w26) / 2 END AS kijun,
  CASE WHEN count(*) OVER w52 = 52 THEN (max(high) OVER w52 + min(low) OVER w52) / 2 END AS mid52, 100 * (close / lag(close, 12) OVER o - 1) AS roc
  FROM bars WINDOW o AS (PARTITION BY symbol ORDER BY ts), w26 AS {_w(26)}, w14 AS {_w(14)}, w9 AS {_w(9)}, w52 AS {_w(52)}, p20 AS {_w(0, "1 PRECEDING", 20)}, p10 AS {_w(0, "1 PRECEDING", 10)}),
b AS (SELECT *, CASE WHEN count(raw) OVER w3 = 3 THEN avg(raw) OVER w3 END AS k, CASE WHEN count(tp) OVER w20 = 20 THEN avg(tp) OVER w20 END AS m, CASE WHEN count(roc) OVER w3 = 3 THEN avg(roc) OVER w3 END AS sm,
  lag((tenkan + kijun) / 2, 26) OVER o AS sa, lag(mid52, 26) OVER o AS sb FROM a WINDOW o AS (PARTITION BY symbol ORDER BY ts), w3 AS {_w(3)}, w20 AS {_w(20)}),
c AS (SELECT *, CASE WHEN count(k) OVER w3 = 3 THEN avg(k) OVER w3 END AS d, abs(tp - m) AS dev, coalesce(sm / nullif(CASE WHEN count(sm) OVER w100 >= 25 THEN stddev_pop(sm) OVER w100 END, 0), 0) AS norm FROM b WINDOW w3 AS {_w(3)}, w100 AS {_w(100)}),
e AS (SELECT *, CASE WHEN count(dev) OVER w20 = 20 THEN (tp - m) / nullif(0.015 * avg(dev) OVER w20, 0) END AS cci, lag(k) OVER o AS pk, lag(d) OVER o AS pd FROM c WINDOW o AS (PARTITION BY symbol ORDER BY ts), w20 AS {_w(20)}),
f AS (SELECT *, CASE WHEN osc <= -50 THEN -1 WHEN osc >= 50 THEN 1 ELSE 0 END AS ra, CASE WHEN cci >= 100 THEN -1 WHEN cci <= -100 THEN 1 ELSE 0 END AS rc, CASE WHEN close <= el THEN -1 WHEN close >= eu THEN 1 ELSE 0 END AS rd,
  CASE WHEN norm <= -0.8 THEN -1 WHEN norm >= 0.8 THEN 1 ELSE 0 END AS rm, CASE WHEN d > k AND pd <= pk AND k >= 65 THEN -1 WHEN k > d AND pk <= pd AND k <= 35 THEN 1 ELSE 0 END AS rs FROM e),
g AS (SELECT *, {", ".join(f"{_HOLD.format(x)} AS h{x}" for x in ("ra", "rc", "rd", "rm", "rs"))} FROM f)
SELECT symbol, ts, CASE WHEN abs(osc) >= 25 THEN hra ELSE 0 END AS aroon, CASE WHEN (hrc > 0 AND cci >= 0) OR (hrc < 0 AND cci <= 0) THEN 0 ELSE hrc END AS cci,
  CASE WHEN (hrd > 0 AND close <= xl) OR (hrd < 0 AND close >= xu) THEN 0 ELSE hrd END AS donchian,
  CASE WHEN tenkan < kijun AND close < least(sa, sb) THEN -1 WHEN tenkan > kijun AND close > greatest(sa, sb) THEN 1 ELSE 0 END AS ichimoku,
  CASE WHEN abs(norm) < 0.1 THEN 0 ELSE hrm END AS momentum, CASE WHEN (hrs > 0 AND k >= 80) OR (hrs < 0 AND k <= 20) THEN 0 ELSE hrs END AS stochastic FROM g""")
def strategy_window_signals(spark, sf_dir):
    """Aroon, CCI, Donchian, Ichimoku, momentum and stochastic rules."""
    return G.window_signals(T.bars_1h(spark, sf_dir))


_STATE = """{name} AS (SELECT symbol, 1::BIGINT AS r, 0 AS now, 0 AS y FROM {source} WHERE r = 1
  UNION ALL SELECT s.symbol, s.r, {next}, CASE WHEN s.{v} IS NULL THEN 0 ELSE {next} END FROM {name} p JOIN {source} s ON s.symbol = p.symbol AND s.r = p.r + 1)"""


def _state(name: str, source: str, v: str, buy: str, sell: str, leave_long: str, leave_short: str) -> str:
    step = f"CASE WHEN s.{v} IS NULL THEN p.now WHEN p.now = 0 THEN CASE WHEN {buy} THEN 1 WHEN {sell} THEN -1 ELSE 0 END WHEN (p.now = 1 AND {leave_long}) OR (p.now = -1 AND {leave_short}) THEN 0 ELSE p.now END"
    return _STATE.format(name=name, source=source, v=v, next=step)


_SUPER = """st AS (SELECT symbol, r, mid + 3 * y AS top, mid - 3 * y AS bottom, 1 AS way, close FROM sx WHERE r = 10
  UNION ALL SELECT s.symbol, s.r, CASE WHEN p.close <= p.top THEN least(s.mid + 3 * s.y, p.top) ELSE s.mid + 3 * s.y END, CASE WHEN p.close >= p.bottom THEN greatest(s.mid - 3 * s.y, p.bottom) ELSE s.mid - 3 * s.y END,
    CASE WHEN s.close > p.top THEN 1 WHEN s.close < p.bottom THEN -1 ELSE p.way END, s.close FROM st p JOIN sx s ON s.symbol = p.symbol AND s.r = p.r + 1)"""

#: Shared by the oracles of all recurrent rules: one row per bar with every indicator that is shown from its warm-up on.
_INDICATORS = f"""{_NUMBERED}, g AS (SELECT *, greatest(d, 0) AS gain, greatest(-d, 0) AS loss, CASE WHEN up > dn AND up > 0 THEN up ELSE 0 END AS pdm, CASE WHEN dn > up AND dn > 0 THEN dn ELSE 0 END AS mdm FROM x),
{ewm_sql("e12", "x", "@close", 1, "(2.0 / 13)")}, {ewm_sql("e26", "x", "@close", 1, "(2.0 / 27)")}, {ewm_sql("e20", "x", "@close", 1, "(2.0 / 21)")}, {ewm_sql("e100", "x", "@close", 1, "(2.0 / 101)")}, {ewm_sql("e200", "x", "@close", 1, "(2.0 / 201)")},
{ewm_sql("a14", "x", "@tr", 1, "(1.0 / 14)")}, {ewm_sql("a20", "x", "@tr", 1, "(1.0 / 20)")}, {ewm_sql("a10", "x", "@tr", 1, "(1.0 / 10)")},
{ewm_sql("ug", "g", "@gain", 2, "(1.0 / 14)")}, {ewm_sql("ul", "g", "@loss", 2, "(1.0 / 14)")}, {ewm_sql("p", "g", "@pdm", 1, "(1.0 / 14)")}, {ewm_sql("q", "g", "@mdm", 1, "(1.0 / 14)")},
ml AS (SELECT e12.symbol, e12.r, e12.y - e26.y AS line FROM e12 JOIN e26 USING (symbol, r) WHERE e12.r >= 26), {ewm_sql("ms", "ml", "@line", 26, "(2.0 / 10)")},
di AS (SELECT symbol, r, p.y AS pd, q.y AS md, 100 * abs(p.y - q.y) / nullif(p.y + q.y, 0) AS dx FROM p JOIN q USING (symbol, r) WHERE r >= 14), {ewm_sql("adx", "di", "@dx", 14, "(1.0 / 14)")},
sx AS (SELECT symbol, r, (high + low) / 2 AS mid, close, a10.y FROM x JOIN a10 USING (symbol, r) WHERE r >= 10), {_SUPER},
i AS (SELECT x.symbol, x.ts, x.r, x.high, x.low, x.close, CASE WHEN x.r >= 14 THEN a14.y END AS atr_14, CASE WHEN x.r >= 20 THEN a20.y END AS atr_20, CASE WHEN x.r >= 20 THEN e20.y END AS ema_20, CASE WHEN x.r >= 100 THEN e100.y END AS ema_100,
  CASE WHEN x.r >= 200 THEN e200.y END AS ema_200, ml.line, CASE WHEN x.r >= 34 THEN ms.y END AS sig, di.pd, di.md, CASE WHEN x.r >= 27 THEN adx.y END AS adx, st.way, CASE WHEN st.way > 0 THEN st.bottom ELSE st.top END AS st_line,
  CASE WHEN x.r >= 15 THEN CASE WHEN ul.y = 0 THEN CASE WHEN ug.y = 0 THEN 50 ELSE 100 END ELSE 100 - 100 / (1 + ug.y / ul.y) END END AS rsi
  FROM x JOIN a14 USING (symbol, r) JOIN a20 USING (symbol, r) JOIN e20 USING (symbol, r) JOIN e100 USING (symbol, r) JOIN e200 USING (symbol, r) LEFT JOIN ml USING (symbol, r) LEFT JOIN ms USING (symbol, r)
  LEFT JOIN di USING (symbol, r) LEFT JOIN adx USING (symbol, r) LEFT JOIN st USING (symbol, r) LEFT JOIN ug USING (symbol, r) LEFT JOIN ul USING (symbol, r)),
j AS (SELECT *, CASE WHEN count(*) OVER w20 = 20 THEN avg(close) OVER w20 END AS fast, CASE WHEN count(*) OVER w50 = 50 THEN avg(close) OVER w50 END AS slow, CASE WHEN count(*) OVER w20 = 20 THEN stddev_pop(close) OVER w20 END AS dev,
  CASE WHEN count(*) OVER w40 = 40 THEN (close - avg(close) OVER w40) / nullif(stddev_pop(close) OVER w40, 0) END AS z, coalesce(abs(ema_200 / lag(ema_200, 20) OVER o - 1), 0) <= 0.03 AS calm, lag(close) OVER o AS before,
  coalesce(atr_14, first_value(atr_14 IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), close * 0.002) AS atr,
  max(CASE WHEN hour(ts) < 7 THEN high END) OVER (PARTITION BY symbol, ts::DATE) AS rh, min(CASE WHEN hour(ts) < 7 THEN low END) OVER (PARTITION BY symbol, ts::DATE) AS rl, hour(ts) BETWEEN 7 AND 19 AS open
  FROM i WINDOW o AS (PARTITION BY symbol ORDER BY ts), w20 AS {_w(20)}, w50 AS {_w(50)}, w40 AS {_w(40)}),
k AS (SELECT *, fast - 2 * dev AS bl, fast + 2 * dev AS bh, abs(fast - slow) >= 0.25 * atr_14 AS apart, lag(atr) OVER (PARTITION BY symbol ORDER BY ts) AS width, atr / close >= 0.0002 AS liquid FROM j),
{_state("rs", "k", "rsi", "s.rsi <= 30", "s.rsi >= 70", "s.rsi >= 50", "s.rsi <= 50")},
{_state("bs", "k", "bh", "s.close <= s.bl", "s.close >= s.bh", "s.close >= s.fast", "s.close <= s.fast")},
l AS (SELECT *, CASE WHEN md > pd AND adx >= 25 THEN -1 WHEN pd > md AND adx >= 25 THEN 1 ELSE 0 END AS ra, CASE WHEN close < ema_20 - 2 * atr_20 THEN -1 WHEN close > ema_20 + 2 * atr_20 THEN 1 ELSE 0 END AS rk,
  CASE WHEN z >= 2 AND calm THEN -1 WHEN z <= -2 AND calm THEN 1 ELSE 0 END AS rz, CASE WHEN open AND close < rl - 0.15 * atr THEN -1 WHEN open AND close > rh + 0.15 * atr THEN 1 ELSE 0 END AS rn,
  CASE WHEN close < before - width AND liquid THEN -1 WHEN close > before + width AND liquid THEN 1 ELSE 0 END AS rv FROM k),
s AS (SELECT *, {", ".join(f"{_HOLD.format(x)} AS h{x}" for x in ("ra", "rk", "rz"))}, coalesce(last_value(nullif(rv, 0) IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 12 PRECEDING AND CURRENT ROW), 0) AS hv,
  coalesce(last_value(nullif(rn, 0) IGNORE NULLS) OVER (PARTITION BY symbol, ts::DATE ORDER BY ts ROWS UNBOUNDED PRECEDING), 0) AS hn FROM l),
signals AS (SELECT s.symbol, s.ts, s.r, s.close, s.atr, s.ema_20, s.atr_20, st_line, CASE WHEN fast < slow AND apart THEN -1 WHEN fast > slow AND apart THEN 1 ELSE 0 END AS sma_cross,
  CASE WHEN line < sig AND close <= ema_100 THEN -1 WHEN line > sig AND close >= ema_100 THEN 1 ELSE 0 END AS macd, rs.y AS rsi, bs.y AS bollinger, CASE WHEN adx >= 18 THEN hra ELSE 0 END AS adx,
  CASE WHEN (hrk > 0 AND close < ema_20) OR (hrk < 0 AND close > ema_20) THEN 0 ELSE hrk END AS keltner, CASE WHEN abs(z) > 0.4 THEN hrz ELSE 0 END AS zscore, coalesce(way, 0) AS supertrend,
  CASE WHEN open THEN hn ELSE 0 END AS session, hv AS volatility FROM s JOIN rs USING (symbol, r) JOIN bs USING (symbol, r))"""
_NAMES = ("sma_cross", "macd", "rsi", "bollinger", "adx", "keltner", "zscore", "supertrend", "session", "volatility")


@query(355, 356, 357, 358, 359, 364, 365, 368, 369, sql=f"{_INDICATORS} SELECT symbol, ts, {', '.join(_NAMES)}, round(st_line, 6) AS line FROM signals")
def strategy_recurrent_signals(spark, sf_dir):
    """SMA cross, MACD, RSI, Bollinger, ADX, Keltner, z-score, SuperTrend (with its line, the stop), session and volatility breakouts."""
    return G.recurrent_signals(T.bars_1h(spark, sf_dir)).select("symbol", "ts", *_NAMES, F.round("line", 6).alias("line"))


@query(370, sql=f"""{_INDICATORS}, f AS (SELECT *, CASE WHEN r <= 30 THEN 0 ELSE keltner END AS signal, macd + adx + supertrend + rsi AS total FROM signals)
SELECT symbol, ts, signal, round(0.35 + 0.6 * coalesce(least(greatest((abs(close - ema_20) / nullif(2 * atr_20, 0) - 0.5) / 2, 0), 1), 0.5), 6) AS confidence,
  CASE WHEN signal <> 0 THEN round(close - 2 * signal * atr, 6) END AS sl, CASE WHEN signal <> 0 THEN round(close + 3 * signal * atr, 6) END AS tp,
  CASE WHEN total >= 2 THEN 1 WHEN total <= -2 THEN -1 ELSE 0 END AS vote FROM f""")
def signal_frame(spark, sf_dir):
    """The Keltner rule as a frame of signal, confidence and ATR stops, flat in its warm-up; beside it the vote of four rules."""
    s = G.recurrent_signals(T.bars_1h(spark, sf_dir))
    votes = s.select("symbol", "ts", G.vote(s, ["macd", "adx", "supertrend", "rsi"], 2).alias("vote"))
    frame = G.framed(s, "keltner", G.scaled_confidence(F.col("excursion"), 0.5, 2.5), 30)
    r = lambda x: F.round(x, 6).alias(x)
    return frame.select("symbol", "ts", "signal", r("confidence"), r("sl"), r("tp")).join(votes, ["symbol", "ts"])
