"""SQL of the scalar functions that DuckDB lacks, from the same published coefficients."""

from __future__ import annotations

from ..functions import scalars as X


def _poly(coefficients: tuple[float, ...], x: str) -> str:
    out = f"({coefficients[0]!r})::DOUBLE"
    for c in coefficients[1:]:
        out = f"(({out}) * ({x}) + ({c!r})::DOUBLE)"
    return out


def erf_sql(x: str) -> str:
    t = f"(1 / (1 + {X._ERF_P!r} * abs({x})))"
    return f"(sign({x}) * (1 - {_poly(X._ERF_A[::-1], t)} * {t} * exp(-({x}) * ({x}))))"


def normal_cdf_sql(x: str) -> str:
    return f"(0.5 * (1 + {erf_sql(f'(({x}) / sqrt(2))')}))"


def two_sided_p_sql(t: str) -> str:
    return f"(1 - {erf_sql(f'(abs({t}) / sqrt(2))')})"


def ppf_sql(p: str) -> str:
    tail = lambda q: f"({_poly(X._C, q)} / {_poly((*X._D, 1.0), q)})"
    left, right, q = f"sqrt(-2 * ln({p}))", f"sqrt(-2 * ln(1 - ({p})))", f"(({p}) - 0.5)"
    mid = f"({_poly(X._A, f'({q} * {q})')} * {q} / {_poly((*X._B, 1.0), f'({q} * {q})')})"
    return f"(CASE WHEN ({p}) <= 0 OR ({p}) >= 1 THEN NULL WHEN ({p}) < 0.02425 THEN {tail(left)} WHEN ({p}) > 1 - 0.02425 THEN -{tail(right)} ELSE {mid} END)"
