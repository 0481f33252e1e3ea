"""Tails of the t, F, beta, gamma and binomial distributions as DuckDB SQL, by series that need no continued fraction."""

from __future__ import annotations

#: Terms of the series. All are positive, and these are enough for parameters up to some hundreds.
TERMS = 700


def _sum(term: str) -> str:
    return f"list_sum(list_transform(range({TERMS}), lambda term_: exp({term})))"


def ibeta(a: str, b: str, x: str) -> str:
    """Regularized incomplete beta: the power series in x up to a quarter, that of the complement above."""

    def series(a: str, b: str, x: str) -> str:
        return _sum(f"lgamma(({a}) + ({b}) + term_) - lgamma(({a}) + 1 + term_) - lgamma({b}) + (({a}) + term_) * ln({x}) + ({b}) * ln(1 - ({x}))")

    low, high = series(a, b, f"({x})"), series(b, a, f"(1 - ({x}))")
    return f"(CASE WHEN ({x}) <= 0 THEN 0.0 WHEN ({x}) >= 1 THEN 1.0 WHEN ({x}) <= 0.25 THEN {low} ELSE 1.0 - {high} END)"


def igamma(a: str, x: str) -> str:
    """Regularized lower incomplete gamma."""
    return f"(CASE WHEN ({x}) <= 0 THEN 0.0 ELSE " + _sum(f"(({a}) + term_) * ln({x}) - ({x}) - lgamma(({a}) + term_ + 1)") + " END)"


def t_cdf(df: str, t: str) -> str:
    tail = f"0.5 * {ibeta(f'0.5 * ({df})', '0.5', f'({df}) / (({df}) + ({t}) * ({t}))')}"
    return f"(CASE WHEN ({t}) >= 0 THEN 1 - {tail} ELSE {tail} END)"


def f_cdf(d1: str, d2: str, f: str) -> str:
    return f"(1 - {ibeta(f'0.5 * ({d2})', f'0.5 * ({d1})', f'({d2}) / (({d2}) + ({d1}) * ({f}))')})"


def chi2_tail(df: str, x: str) -> str:
    return f"(1 - {igamma(f'({df}) / 2.0', f'({x}) / 2.0')})"


def order_tail(n: str, q: str, m: str) -> str:
    """Chance that the m-th smallest of n uniform values is at most q."""
    return ibeta(m, f"({n}) - ({m}) + 1", q)


def binomial_tail(n: str, p: str, k: str) -> str:
    return f"(CASE WHEN ({k}) >= ({n}) THEN 1.0 ELSE 1 - {ibeta(f'least({k}, ({n}) - 1) + 1', f'({n}) - least({k}, ({n}) - 1)', p)} END)"


def inverse(of, p: str, low: str = "0", high: str = "1", steps: int = 56) -> str:
    """Where the rising function ``of`` (SQL of an argument) reaches p, by bisection."""
    start = f"list_transform(range({steps + 1}), lambda z: {{'lo': CAST({low} AS DOUBLE), 'hi': CAST({high} AS DOUBLE)}})"
    mid = "((held_.lo + held_.hi) / 2)"
    found = f"list_reduce({start}, lambda held_, step_: CASE WHEN {of(mid)} < ({p}) THEN {{'lo': {mid}, 'hi': held_.hi}} ELSE {{'lo': held_.lo, 'hi': {mid}}} END)"
    return f"list_transform([{found}], lambda v: (v.lo + v.hi) / 2)[1]"


def quantile_confidence(n: str, m: str, p: str) -> str:
    return inverse(lambda x: order_tail(n, x, m), p)
