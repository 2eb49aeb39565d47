"""Scalar functions as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Abramowitz and Stegun 7.1.26.
_ERF_P, _ERF_A = 0.3275911, (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
# Acklam's rational approximation of the normal quantile.
_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01)
_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00)
#: Minutes of a timeframe.
TIMEFRAMES = {"M1": 1, "M5": 5, "M15": 15, "M30": 30, "H1": 60, "H4": 240, "D1": 1440, "W1": 10080, "MN1": 43200}
EULER_GAMMA = 0.5772156649015329


def _poly(coefficients: tuple[float, ...], x: Column) -> Column:
    """Horner, highest power first."""
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + c
    return out


def erf(x: Column) -> Column:
    t = 1 / (1 + _ERF_P * F.abs(x))
    return F.signum(x) * (1 - _poly(_ERF_A[::-1], t) * t * F.exp(-x * x))


def normal_cdf(x: Column) -> Column:
    return 0.5 * (1 + erf(x / math.sqrt(2)))


def two_sided_p(t: Column) -> Column:
    return 1 - erf(F.abs(t) / math.sqrt(2))


def normal_ppf(p: Column) -> Column:
    """Null outside (0, 1)."""
    low = 0.02425
    tail = lambda q: _poly(_C, q) / _poly((*_D, 1.0), q)
    left, right = F.sqrt(-2 * F.ln(p)), F.sqrt(-2 * F.ln(1 - p))
    q = p - 0.5
    mid = _poly(_A, q * q) * q / _poly((*_B, 1.0), q * q)
    return F.when((p <= 0) | (p >= 1), None).when(p < low, tail(left)).when(p > 1 - low, -tail(right)).otherwise(mid)


def expected_max_sharpe(trials: Column, deviation: Column) -> Column:
    n = F.greatest(trials, F.lit(2))
    return deviation * ((1 - EULER_GAMMA) * normal_ppf(1 - 1 / n) + EULER_GAMMA * normal_ppf(1 - 1 / (n * math.e)))


def deflated_sharpe(sr: Column, best: Column, n: Column, skew: Column, kurt: Column) -> Column:
    """Probability that a per-observation ratio beats the best expected by chance; null where the variance term is not positive. kurt is not excess."""
    under = 1 - skew * sr + (kurt - 1) / 4 * sr * sr
    return F.when(under > 0, normal_cdf((sr - best) * F.sqrt(n - 1) / F.sqrt(under)))


def floor_to_step(value: Column, step: Column | float) -> Column:
    return F.floor(value / step + 1e-9) * step


def volume_grid(lots: Column, step: float, least: float, most: float) -> Column:
    on = floor_to_step(lots, F.lit(step))
    return F.when(on < least, 0.0).when(on.isNotNull(), F.round(F.least(on, F.lit(most)), 2))


def position_pnl(entry: Column, exit_: Column, direction: Column, lots: Column, contract: Column, inverse: Column) -> Column:
    raw = (exit_ - entry) * direction * contract * lots
    return F.when(inverse, raw / exit_).otherwise(raw)


def notional(price: Column, lots: Column, contract: Column, inverse: Column) -> Column:
    return F.when(inverse, contract * lots).otherwise(contract * lots * price)


def risk_lots(capital: Column, risk: float, loss_per_lot: Column, step: float = 0.01, least: float = 0.01, most: float = 100.0) -> Column:
    return F.when(loss_per_lot <= 0, 0.0).otherwise(volume_grid(F.try_divide(capital * risk, F.nullif(loss_per_lot, F.lit(0.0))), step, least, most))


def kelly(p: Column, b: Column) -> Column:
    return F.greatest(p - F.try_divide(1 - p, b), F.lit(0.0))


def confidence(x: Column) -> Column:
    """0.35 + 0.6 * x clipped to [0, 1]; a missing x counts as 0.5."""
    return 0.35 + 0.6 * F.least(F.greatest(F.coalesce(x, F.lit(0.5)), F.lit(0.0)), F.lit(1.0))


def timeframe_minutes(label: Column) -> Column:
    out = F
    for name, minutes in TIMEFRAMES.items():
        out = out.when(label == name, minutes)
    return out


def bars_per_year(minutes: Column) -> Column:
    return F.greatest(F.lit(252.0 * 1440) / minutes, F.lit(1.0))


def clip_parameter(x: Column, low: float, high: float, integer: bool) -> Column:
    """Integers round half to even, others to 6 digits; a declared step plays no part."""
    inside = F.least(F.greatest(x, F.lit(low)), F.lit(high))
    return F.bround(inside, 0) if integer else F.round(inside, 6)


def weekend(ts: Column) -> Column:
    """Friday 22:00 to Sunday 22:00."""
    d, h = F.weekday(ts), F.hour(ts)
    return ((d == 4) & (h >= 22)) | (d == 5) | ((d == 6) & (h < 22))


def weekend_corrected(ts: Column) -> Column:
    """Saturday 01:00 to Monday 05:00."""
    d, h = F.weekday(ts), F.hour(ts)
    return ((d == 5) & (h >= 1)) | (d == 6) | ((d == 0) & (h < 5))


def session(ts: Column) -> Column:
    h = F.hour(ts)
    return F.when(h < 7, "asia").when(h < 12, "london").when(h < 17, "overlap").otherwise("late")


def timeframe_floor(ts: Column, seconds: int) -> Column:
    micros = F.unix_micros(ts.cast("timestamp"))
    return F.timestamp_seconds(F.floor(micros / (seconds * 1_000_000)) * seconds).cast("timestamp_ntz")


def round_digits(x: Column, digits: Column) -> Column:
    """round() wants a literal scale; this one takes the row's own."""
    return F.round(x * F.pow(F.lit(10.0), digits)) / F.pow(F.lit(10.0), digits)


def round_trip_cost(symbol: Column, costs: dict[str, float]) -> Column:
    """The symbol's cost of costs; one that is not listed raises when its row is read."""
    out = F
    for name, cost in costs.items():
        out = out.when(symbol == name, cost)
    return out.otherwise(F.raise_error(F.concat(F.lit("no cost is registered for "), symbol)).cast("double"))
