"""Indicators that feed on their own last value: one vectorized pass a series."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def ema_values(x: np.ndarray, n: int) -> np.ndarray:
    """Seeded with the mean of the first n values at n-1, then smoothed by 2/(n+1)."""
    out = np.full(len(x), np.nan)
    if n < 1 or len(x) < n:
        return out
    held = np.concatenate([[x[:n].mean()], x[n:]])
    out[n - 1 :] = pd.Series(held).ewm(alpha=2.0 / (n + 1), adjust=False).mean().to_numpy()
    return out


def _smoothed(seed: float, values: np.ndarray, alpha: float) -> np.ndarray:
    return pd.Series(np.concatenate([[seed], values])).ewm(alpha=alpha, adjust=False).mean().to_numpy()


def rsi_wilder_values(x: np.ndarray, n: int) -> np.ndarray:
    """0 to 100; the first n values are missing; 100 where no loss is left."""
    out = np.full(len(x), np.nan)
    if n < 1 or len(x) <= n:
        return out
    step = np.diff(x)
    gain, loss = np.maximum(step, 0.0), np.maximum(-step, 0.0)
    g = _smoothed(gain[:n].mean(), gain[n:], 1.0 / n)
    lo = _smoothed(loss[:n].mean(), loss[n:], 1.0 / n)
    with np.errstate(divide="ignore", invalid="ignore"):
        out[n:] = np.where(lo == 0, 100.0, 100.0 - 100.0 / (1.0 + g / lo))
    return out


def rsi_ema_values(x: np.ndarray, n: int, start: int) -> np.ndarray:
    """In [-1, 1] from ``start`` on: seeded by the means that end there, then smoothed by 1/n with that bar's step again."""
    out = np.zeros(len(x))
    if n < 1 or start < n or len(x) <= start:
        return out
    step = np.diff(x)
    gain, loss = np.maximum(step, 0.0), np.maximum(-step, 0.0)
    g = _smoothed(gain[start - n : start].mean(), gain[start - 1 :], 1.0 / n)[1:]
    lo = _smoothed(loss[start - n : start].mean(), loss[start - 1 :], 1.0 / n)[1:]
    with np.errstate(divide="ignore", invalid="ignore"):
        rsi = np.where((g < 1e-10) & (lo < 1e-10), 50.0, np.where(lo < 1e-10, 100.0, 100.0 - 100.0 / (1.0 + g / lo)))
    out[start:] = (rsi - 50.0) / 50.0
    return out


def macd_values(x: np.ndarray, fast: int, slow: int, signal: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(line, signal, histogram); the signal smooths the part of the line that is there."""
    line = ema_values(x, fast) - ema_values(x, slow)
    smooth = np.full(len(x), np.nan)
    there = np.flatnonzero(~np.isnan(line))
    if len(there):
        smooth[there[0] :] = ema_values(line[there[0] :], signal)
    return line, smooth, line - smooth


def per_series(df: DataFrame, columns: dict[str, Callable[[np.ndarray], np.ndarray]], x: str = "x", by: str = "symbol", i: str = "i") -> DataFrame:
    """``by, i, x`` and a column for each function of the ordered series; missing values are NULL."""
    held = df.select(by, i, x)
    names = list(columns)

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(i, kind="stable")
        values = part[x].to_numpy(dtype=float)
        out = part.assign(**{n: columns[n](values) for n in names})
        return out.astype(object).where(out.notna(), None)

    kinds = {f.name: f.dataType.simpleString() for f in held.schema}
    schema = ", ".join([f"{c} {kinds[c]}" for c in (by, i, x)] + [f"{n} double" for n in names])
    return held.groupBy(by).applyInPandas(run, schema)


def ema(df: DataFrame, n: int, **kw) -> DataFrame:
    return per_series(df, {"ema": lambda v: ema_values(v, n)}, **kw)


def rsi_wilder(df: DataFrame, n: int, **kw) -> DataFrame:
    return per_series(df, {"rsi": lambda v: rsi_wilder_values(v, n)}, **kw)


def rsi_ema(df: DataFrame, n: int, start: int, **kw) -> DataFrame:
    return per_series(df, {"rsi": lambda v: rsi_ema_values(v, n, start)}, **kw)


def macd(df: DataFrame, fast: int, slow: int, signal: int, **kw) -> DataFrame:
    part = lambda k: lambda v: macd_values(v, fast, slow, signal)[k]
    return per_series(df, {"macd": part(0), "signal": part(1), "histogram": part(2)}, **kw)


def crossovers(df: DataFrame, short: int, long: int, signal: int = 9, **kw) -> DataFrame:
    """The crossover family of one pair of lookbacks: moving average, RSI, EMA, rate of change, MACD histogram."""

    def mean(v: np.ndarray, n: int) -> np.ndarray:
        return pd.Series(v).rolling(n).mean().to_numpy()

    def change(v: np.ndarray, n: int) -> np.ndarray:
        old = pd.Series(v).shift(n).to_numpy()
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(old == 0, np.nan, (v - old) / old)

    made = {
        "ma": lambda v: mean(v, short) - mean(v, long),
        "rsi": lambda v: rsi_wilder_values(v, short) - rsi_wilder_values(v, long),
        "ema": lambda v: ema_values(v, short) - ema_values(v, long),
        "roc": lambda v: change(v, short) - change(v, long),
        "macd": lambda v: macd_values(v, short, long, signal)[2],
    }
    return per_series(df, made, **kw)
