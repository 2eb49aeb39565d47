"""Trading rules as signal columns of bars: 1 long, -1 short, 0 flat.

Rules over rolling windows are window columns. Averages that carry their own
previous value and positions that hold until an exit come from one pandas
function per series of bars (see recurrence), which adds all of them in one pass.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rolling as R
from . import bars as B
from . import recurrence as K

#: The default parameters of the rules.
SL_ATR, TP_ATR = 2.0, 3.0


def side(long: Column, short: Column) -> Column:
    """1, -1 or 0; where both hold, short."""
    return F.when(short, -1).when(long, 1).otherwise(0)


def left(held: Column, exit_long: Column, exit_short: Column) -> Column:
    """The held side, 0 in rows where its exit holds; a missing value is no exit."""
    return F.when(((held > 0) & exit_long) | ((held < 0) & exit_short), 0).otherwise(held)


def scaled_confidence(x: Column, low: float, high: float) -> Column:
    """0.35 to 0.95 over [low, high]; a missing value counts as the middle."""
    return 0.35 + 0.6 * F.coalesce(F.least(F.greatest((x - low) / (high - low), F.lit(0.0)), F.lit(1.0)), F.lit(0.5))


def window_signals(bars: DataFrame) -> DataFrame:
    """symbol, ts, aroon, cci, donchian, ichimoku, momentum, stochastic."""
    w = R.series("symbol")
    h, low, c = F.col("high"), F.col("low"), F.col("close")
    up, down = R.aroon(h, low, 25, w)
    (eu, el), (xu, xl) = R.donchian(h, low, 20, w, upto=-1), R.donchian(h, low, 10, w, upto=-1)
    got = bars.select(
        "symbol", "ts", "high", "low", "close", (up - down).alias("osc"), eu.alias("eu"), el.alias("el"), xu.alias("xu"), xl.alias("xl"), R.roc(c, 12, w).alias("roc"),
        R.midpoint(h, low, 9, w).alias("tenkan"), R.midpoint(h, low, 26, w).alias("kijun"), R.midpoint(h, low, 52, w).alias("mid52"),
    )
    got = B.stochastic_cci(got, w)
    got = got.withColumns({"sa": F.lag((F.col("tenkan") + F.col("kijun")) / 2, 26).over(w), "sb": F.lag("mid52", 26).over(w), "sm": R.sma(F.col("roc"), 3, w)})
    frame = w.rowsBetween(-99, 0)
    spread = F.when(F.count("sm").over(frame) >= 25, F.stddev_pop("sm").over(frame))
    got = got.withColumn("norm", F.coalesce(F.try_divide(F.col("sm"), F.nullif(spread, F.lit(0.0))), F.lit(0.0)))
    k, d, cci, osc, norm = (F.col(x) for x in ("k", "d", "cci", "osc", "norm"))
    raws = {
        "aroon_": side(osc >= 50, osc <= -50), "cci_": side(cci <= -100, cci >= 100), "donchian_": side(c >= F.col("eu"), c <= F.col("el")), "momentum_": side(norm >= 0.8, norm <= -0.8),
        "stochastic_": side((R.crossover(k, d, w) == 1) & (k <= 35), (R.crossover(d, k, w) == 1) & (k >= 65)),
    }
    got = got.withColumns(raws).withColumns({name: R.hold(F.col(name), w) for name in raws})
    tenkan, kijun = F.col("tenkan"), F.col("kijun")
    top, bottom = F.greatest("sa", "sb"), F.least("sa", "sb")
    return got.select(
        "symbol", "ts", F.when(F.abs(osc) >= 25, F.col("aroon_")).otherwise(0).alias("aroon"), left(F.col("cci_"), cci >= 0, cci <= 0).alias("cci"),
        left(F.col("donchian_"), c <= F.col("xl"), c >= F.col("xu")).alias("donchian"), side((tenkan > kijun) & (c > top), (tenkan < kijun) & (c < bottom)).alias("ichimoku"),
        F.when(F.abs(norm) < 0.1, 0).otherwise(F.col("momentum_")).alias("momentum"), left(F.col("stochastic_"), k >= 80, k <= 20).alias("stochastic"),
    )


def hysteresis(value: np.ndarray, buy: np.ndarray, sell: np.ndarray, leave_long: np.ndarray, leave_short: np.ndarray) -> np.ndarray:
    """Positions that are entered only when flat and held until their exit; a missing value shows 0 and keeps the state."""
    out, now = np.zeros(len(value), dtype="i8"), 0
    for i, v in enumerate(value):
        if v != v:
            continue
        if now == 0:
            now = 1 if buy[i] else -1 if sell[i] else 0
        elif (now == 1 and leave_long[i]) or (now == -1 and leave_short[i]):
            now = 0
        out[i] = now
    return out


_RECURRENT = ("atr_14", "atr_20", "ema_20", "ema_100", "ema_200", "macd", "macd_signal", "adx", "plus", "minus", "st_line")


def recurrent_columns(bars: DataFrame) -> DataFrame:
    """bars (symbol, ts, high, low, close) with what the recurrent rules need, from one pass over each series."""
    w = R.series("symbol")
    low, mid, high = R.bollinger(F.col("close"), 20, 2.0, w)
    source = bars.select("symbol", "ts", "high", "low", "close", low.alias("bb_low"), mid.alias("bb_mid"), high.alias("bb_high"))

    def run(f):
        h, lo, c, bl, bm, bh = (f[x].to_numpy("f8") for x in ("high", "low", "close", "bb_low", "bb_mid", "bb_high"))
        line, sig, _ = K.macd(c)
        adx, plus, minus = K.adx(h, lo, c)
        st_line, st_way = K.supertrend(h, lo, c)
        rsi = K.rsi(c, 14)
        with np.errstate(invalid="ignore"):
            rsi_side = hysteresis(rsi, rsi <= 30, rsi >= 70, rsi >= 50, rsi <= 50)
            bb_side = hysteresis(bh, c <= bl, c >= bh, c >= bm, c <= bm)
        return {
            "atr_14": K.atr(h, lo, c, 14), "atr_20": K.atr(h, lo, c, 20), "ema_20": K.ema(c, 20), "ema_100": K.ema(c, 100), "ema_200": K.ema(c, 200), "macd": line, "macd_signal": sig,
            "adx": adx, "plus": plus, "minus": minus, "st_line": st_line, "st_way": st_way, "rsi_side": rsi_side, "bb_side": bb_side,
        }

    kinds = dict.fromkeys(_RECURRENT, "double") | dict.fromkeys(("st_way", "rsi_side", "bb_side"), "long")
    return K.per_symbol(source, run, kinds)


def filled_atr(w) -> Column:
    """ATR with the missing values before it taken from the first; a fraction of the close where there is none."""
    return F.coalesce("atr_14", F.first("atr_14", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing)), F.col("close") * 0.002)


def recurrent_signals(bars: DataFrame) -> DataFrame:
    """symbol, ts, sma_cross, macd, rsi, bollinger, adx, keltner, zscore, supertrend, session, volatility, and close, atr and line for stops."""
    w = R.series("symbol")
    day = Window.partitionBy("symbol", F.to_date("ts"))
    c = F.col("close")
    got = recurrent_columns(bars)
    in_range = F.hour("ts") < 7
    got = got.withColumns({
        "fast": R.sma(c, 20, w), "slow": R.sma(c, 50, w), "z": R.zscore(c, 40, w), "slope": F.coalesce(F.abs(F.try_divide(F.col("ema_200"), F.lag("ema_200", 20).over(w)) - 1), F.lit(0.0)),
        "atr": filled_atr(w), "range_high": F.max(F.when(in_range, F.col("high"))).over(day), "range_low": F.min(F.when(in_range, F.col("low"))).over(day), "before": F.lag("close").over(w),
    })
    got = got.withColumn("width", F.lag("atr").over(w))
    atr, z, adx = F.col("atr"), F.col("z"), F.col("adx")
    apart = F.abs(F.col("fast") - F.col("slow")) >= 0.25 * F.col("atr_14")
    open_ = (F.hour("ts") >= 7) & (F.hour("ts") < 20)
    calm, liquid = F.col("slope") <= 0.03, F.coalesce(F.try_divide(atr, c), F.lit(0.0)) >= 0.0002
    kc = 2.0 * F.col("atr_20")
    raws = {
        "adx_": side((F.col("plus") > F.col("minus")) & (adx >= 25), (F.col("minus") > F.col("plus")) & (adx >= 25)),
        "keltner_": side(c > F.col("ema_20") + kc, c < F.col("ema_20") - kc), "zscore_": side((z <= -2) & calm, (z >= 2) & calm),
        "session_": side(open_ & (c > F.col("range_high") + 0.15 * atr), open_ & (c < F.col("range_low") - 0.15 * atr)),
        "volatility_": side((c > F.col("before") + F.col("width")) & liquid, (c < F.col("before") - F.col("width")) & liquid),
    }
    got = got.withColumns(raws)
    in_day = day.orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    line, sig = F.col("macd"), F.col("macd_signal")
    held = {x: R.hold(F.col(x), w) for x in ("adx_", "keltner_", "zscore_")}
    held |= {"session_": F.coalesce(F.last(F.nullif("session_", F.lit(0)), ignorenulls=True).over(in_day), F.lit(0)), "volatility_": F.coalesce(R.limited_fill(F.nullif("volatility_", F.lit(0)), 12, w), F.lit(0))}
    got = got.withColumns(held)
    return got.select(
        "symbol", "ts", side((F.col("fast") > F.col("slow")) & apart, (F.col("fast") < F.col("slow")) & apart).alias("sma_cross"),
        side((line > sig) & (c >= F.col("ema_100")), (line < sig) & (c <= F.col("ema_100"))).alias("macd"), F.col("rsi_side").alias("rsi"), F.col("bb_side").alias("bollinger"),
        F.when(adx >= 18, F.col("adx_")).otherwise(0).alias("adx"), left(F.col("keltner_"), c < F.col("ema_20"), c > F.col("ema_20")).alias("keltner"),
        F.when(F.abs(z) > 0.4, F.col("zscore_")).otherwise(0).alias("zscore"), F.when(F.col("st_line").isNotNull(), F.col("st_way")).otherwise(0).alias("supertrend"),
        F.when(open_, F.col("session_")).otherwise(0).alias("session"), F.col("volatility_").alias("volatility"), "close", "atr", F.col("st_line").alias("line"),
        ((F.abs(c - F.col("ema_20"))) / F.nullif(kc, F.lit(0.0))).alias("excursion"),
    )


def framed(signals: DataFrame, signal: str, confidence: Column, warm: int = 0) -> DataFrame:
    """symbol, ts, signal, confidence, sl, tp: ATR stops where the signal is not 0; the first `warm` rows of a series are flat."""
    w = R.series("symbol")
    s = F.when(F.row_number().over(w) <= warm, 0).otherwise(F.signum(signal).cast("int"))
    got = signals.withColumn("_s", s)
    stop = lambda k: F.when(F.col("_s") != 0, F.col("close") + k * F.col("_s") * F.col("atr"))
    return got.select("symbol", "ts", F.col("_s").alias("signal"), F.least(F.greatest(confidence, F.lit(0.0)), F.lit(1.0)).alias("confidence"), stop(-SL_ATR).alias("sl"), stop(TP_ATR).alias("tp"))


def vote(signals: DataFrame, members: list[str], least: int) -> Column:
    """Side of members whose signals sum to at least `least` either way, each counting one."""
    total = sum((F.col(m) for m in members), F.lit(0))
    return side(total >= least, total <= -least)
