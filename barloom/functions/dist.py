"""Distribution functions. What SQL can express is SQL text that any engine reads; the rest are Arrow functions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Abramowitz and Stegun 26.2.17 and 26.2.23.
CDF_T, CDF_B = 0.2316419, (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)
INV_C, INV_D = (2.515517, 0.802853, 0.010328), (1.432788, 0.189269, 0.001308)
# Lanczos's approximation, g = 7, nine terms.
LANCZOS = (
    0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059,
    12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7,
)


def normal_cdf_sql(z: str) -> str:
    t = f"(1.0E0 / (1.0E0 + {CDF_T}E0 * abs({z})))"
    poly = "0.0E0"
    for b in reversed(CDF_B):
        poly = f"({poly} * {t} + {b}E0)"
    tail = f"(exp(-0.5E0 * ({z}) * ({z})) * 0.3989422804014327E0 * {t} * {poly})"
    return f"(CASE WHEN ({z}) > 0 THEN 1.0E0 - {tail} ELSE {tail} END)"


def inverse_normal_sql(p: str) -> str:
    q = f"least(({p}), 1.0E0 - ({p}))"
    t = f"sqrt(-2.0E0 * ln({q}))"
    num = f"({INV_C[0]}E0 + {t} * ({INV_C[1]}E0 + {t} * {INV_C[2]}E0))"
    den = f"(1.0E0 + {t} * ({INV_D[0]}E0 + {t} * ({INV_D[1]}E0 + {t} * {INV_D[2]}E0)))"
    return f"(CASE WHEN ({p}) > 0.5E0 THEN 1.0E0 ELSE -1.0E0 END * ({t} - {num} / {den}))"


def erfc_sql(x: str) -> str:
    return f"(2.0E0 * (1.0E0 - {normal_cdf_sql(f'(1.4142135623730951E0 * ({x}))')}))"


def half_normal_sql(x: str) -> str:
    """CDF of |Z|."""
    return f"(2.0E0 * {normal_cdf_sql(x)} - 1.0E0)"


def log_gamma_sql(x: str) -> str:
    """ln Gamma by Lanczos; 0 for x <= 0."""
    z = f"(({x}) - 1.0E0)"
    series = f"({LANCZOS[0]}E0" + "".join(f" + ({c:.17g}E0) / ({z} + {k}.0E0)".replace("e-06E0", "E-6").replace("e-07E0", "E-7") for k, c in enumerate(LANCZOS[1:], 1)) + ")"
    t = f"({z} + 7.5E0)"
    return f"(CASE WHEN ({x}) <= 0 THEN 0.0E0 ELSE 0.9189385332046727E0 + ({z} + 0.5E0) * ln(greatest({t}, 1.0E-300)) - {t} + ln(greatest({series}, 1.0E-300)) END)"


def poisson_sql(k: str, lam: str) -> str:
    return f"exp(-({lam}) + ({k}) * ln({lam}) - {log_gamma_sql(f'(({k}) + 1.0E0)')})"


def anderson_darling_sql(z: str) -> str:
    """Upper tail of the Anderson-Darling statistic, in pieces."""
    return (
        f"(CASE WHEN ({z}) < 0.01E0 THEN 1.0E0 WHEN ({z}) <= 2.0E0 THEN 1.0E0 - 2.0E0 * exp(-1.2337E0 / ({z})) * (1.0E0 + ({z}) / 8.0E0 - 0.04958E0 * ({z}) * ({z}) / (1.325E0 + ({z}))) / sqrt({z}) "
        f"WHEN ({z}) <= 4.0E0 THEN 1.0E0 - (1.0E0 - 0.6621361E0 * exp(-1.091638E0 * ({z})) - 0.95095E0 * exp(-2.005138E0 * ({z}))) "
        f"ELSE 1.0E0 - (1.0E0 - 0.4938691E0 * exp(-1.050321E0 * ({z})) - 0.5946335E0 * exp(-1.527198E0 * ({z}))) END)"
    )


def ks_cdf(n: Column, d: Column) -> Column:
    """Kolmogorov's distribution of D for n cases, by at most 99 terms of its series."""
    z = (F.sqrt(n) + 0.12 + F.lit(0.11) / F.sqrt(n)) * d
    term = lambda j: F.when(j % 2 == 1, F.lit(2.0)).otherwise(F.lit(-2.0)) * F.exp(j * j * z * z * F.lit(-2.0))
    return F.lit(1.0) - F.aggregate(F.sequence(F.lit(1), F.lit(99)), F.lit(0.0), lambda a, j: a + term(j))


def ks_inverse(n: Column, p: Column) -> Column:
    """D whose leading term has upper tail 1 - p."""
    return F.sqrt(F.log(F.lit(2.0) / (F.lit(1.0) - p)) * 0.5) / (F.sqrt(n) + 0.12 + F.lit(0.11) / F.sqrt(n))


def gamma_half(n2: Column) -> Column:
    """Gamma(n2 / 2) for whole n2 >= 1, by its recursion."""
    start = F.when(n2 % 2 == 0, F.lit(1.0)).otherwise(F.lit(float(np.sqrt(np.pi))))
    low = F.when(n2 % 2 == 0, F.lit(2)).otherwise(F.lit(1))
    steps = F.when(n2 > low, F.sequence(low, (n2 - 2).cast("int"), F.lit(2))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, start, lambda a, k: a * k / 2.0)


def combinations(n: Column, m: Column) -> Column:
    """n over m as a product of doubles."""
    steps = F.when(m > 0, F.sequence(F.lit(1), m.cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, F.lit(1.0), lambda a, k: a * (n - m + k) / k)


def log_gamma(x: np.ndarray) -> np.ndarray:
    z = np.asarray(x, dtype=float) - 1.0
    series = np.full_like(z, LANCZOS[0])
    for k, c in enumerate(LANCZOS[1:], 1):
        series = series + c / (z + k)
    t = z + 7.5
    return 0.5 * np.log(2 * np.pi) + (z + 0.5) * np.log(t) - t + np.log(series)


def ibeta(a, b, x) -> np.ndarray:
    """Regularized incomplete beta by the modified Lentz fraction, on the faster-converging side."""
    a, b, x = (np.asarray(v, dtype=float) for v in np.broadcast_arrays(a, b, x))
    flip = x > (a + 1) / (a + b + 2)
    p, q, y = np.where(flip, b, a), np.where(flip, a, b), np.clip(np.where(flip, 1 - x, x), 0, 1)
    tiny = 1e-300
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        front = np.exp(log_gamma(p + q) - log_gamma(p) - log_gamma(q) + p * np.log(np.maximum(y, tiny)) + q * np.log1p(-np.minimum(y, 1 - 1e-16)))
        c, d = np.ones_like(p), 1 - (p + q) * y / (p + 1)
        d = 1 / np.where(np.abs(d) < tiny, tiny, d)
        h = d
        for m in range(1, 300):
            for num in (m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1))):
                d = 1 + num * d
                d = 1 / np.where(np.abs(d) < tiny, tiny, d)
                c = 1 + num / np.where(np.abs(c) < tiny, tiny, c)
                h = h * d * c
            if np.all(np.abs(d * c - 1) < 1e-15):
                break
        out = front * h / p
    out = np.where(y <= 0, 0.0, np.where(y >= 1, 1.0, out))
    return np.where(flip, 1 - out, out)


def igamma(a, x) -> np.ndarray:
    """Regularized lower incomplete gamma: series below a + 1, fraction above."""
    a, x = (np.asarray(v, dtype=float) for v in np.broadcast_arrays(a, x))
    y = np.maximum(x, 1e-300)
    front = np.exp(a * np.log(y) - y - log_gamma(a))
    term = total = 1 / a
    for k in range(1, 500):
        term = term * y / (a + k)
        total = total + term
        if np.all(np.abs(term) < 1e-16 * np.abs(total)):
            break
    b = y + 1 - a
    tiny = 1e-300
    c, d = np.full_like(y, 1 / tiny), 1 / np.where(np.abs(b) < tiny, tiny, b)
    h = d
    with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
        for k in range(1, 500):
            num = -k * (k - a)
            b = b + 2
            d = num * d + b
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = b + num / np.where(np.abs(c) < tiny, tiny, c)
            h = h * d * c
            if np.all(np.abs(d * c - 1) < 1e-15):
                break
    out = np.where(y < a + 1, front * total, 1 - front * h)
    return np.where(x <= 0, 0.0, np.clip(out, 0, 1))


def inverse_ibeta(p, a, b) -> np.ndarray:
    """x with ibeta(a, b, x) = p, by bisection to the last bit."""
    p, a, b = (np.asarray(v, dtype=float) for v in np.broadcast_arrays(p, a, b))
    low, high = np.zeros_like(p), np.ones_like(p)
    for _ in range(60):
        mid = (low + high) / 2
        below = ibeta(a, b, mid) < p
        low, high = np.where(below, mid, low), np.where(below, high, mid)
    return (low + high) / 2


def t_cdf_values(df, t) -> np.ndarray:
    df, t = (np.asarray(v, dtype=float) for v in np.broadcast_arrays(df, t))
    tail = 0.5 * ibeta(0.5 * df, 0.5, df / (df + t * t))
    return np.where(t >= 0, 1 - tail, tail)


def inverse_t_values(df, p) -> np.ndarray:
    df, p = (np.asarray(v, dtype=float) for v in np.broadcast_arrays(df, p))
    low, high = np.full_like(p, -1e4), np.full_like(p, 1e4)
    for _ in range(80):
        mid = (low + high) / 2
        below = t_cdf_values(df, mid) < p
        low, high = np.where(below, mid, low), np.where(below, high, mid)
    return (low + high) / 2


def f_cdf_values(d1, d2, f) -> np.ndarray:
    d1, d2, f = (np.asarray(v, dtype=float) for v in np.broadcast_arrays(d1, d2, f))
    f = np.maximum(f, 0)
    return 1 - ibeta(0.5 * d2, 0.5 * d1, d2 / (d2 + d1 * f))


def order_tail_values(n, q, m) -> np.ndarray:
    """Chance that the m-th smallest of n falls at or below the quantile q."""
    return ibeta(np.asarray(m, dtype=float), np.asarray(n, dtype=float) - m + 1, q)


def quantile_confidence_values(n, m, p) -> np.ndarray:
    """The quantile below which the m-th smallest of n falls with chance p."""
    return inverse_ibeta(p, np.asarray(m, dtype=float), np.asarray(n, dtype=float) - m + 1)


def binomial_tail_values(n, p, k) -> np.ndarray:
    """Chance of at most k successes of n."""
    n, p, k = (np.asarray(v, dtype=float) for v in np.broadcast_arrays(n, p, k))
    inside = np.minimum(k, n - 1)
    return np.where(k >= n, 1.0, 1 - ibeta(inside + 1, n - inside, p))


def arrow(values):
    """A Column function that applies ``values`` to whole Arrow batches."""

    def run(*columns: pd.Series) -> pd.Series:
        return pd.Series(values(*(c.to_numpy(dtype=float) for c in columns)))

    def one(a: pd.Series) -> pd.Series:
        return run(a)

    def two(a: pd.Series, b: pd.Series) -> pd.Series:
        return run(a, b)

    def three(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
        return run(a, b, c)

    by_arity = {1: one, 2: two, 3: three}
    return lambda *args: F.pandas_udf(by_arity[len(args)], "double")(*args)


incomplete_beta, incomplete_gamma, inverse_beta = arrow(ibeta), arrow(igamma), arrow(inverse_ibeta)
t_cdf, inverse_t, f_cdf = arrow(t_cdf_values), arrow(inverse_t_values), arrow(f_cdf_values)
order_tail, quantile_confidence, binomial_tail = arrow(order_tail_values), arrow(quantile_confidence_values), arrow(binomial_tail_values)
chi2_tail = arrow(lambda df, x: 1 - igamma(df / 2, x / 2))
