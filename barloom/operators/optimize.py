"""Optimizers whose criterion is evaluated for a whole generation at once."""

from __future__ import annotations

from collections.abc import Callable, Generator, Hashable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.scratch import kept
from .ordered import same

Evaluate = Callable[[np.ndarray], np.ndarray]  # (candidates, parameters) -> values; higher is better
Search = Generator[np.ndarray, np.ndarray, tuple]  # gives candidates, takes their values, returns what it found


@dataclass(frozen=True)
class Bounds:
    low: tuple[float, ...]
    high: tuple[float, ...]
    whole: int = 0  # so many leading parameters are whole numbers


def legalize(points: np.ndarray, bounds: Bounds) -> tuple[np.ndarray, np.ndarray]:
    """(points within bounds, whole numbers rounded half away from zero; penalty of each for its excess)."""
    out = np.array(points, dtype=float)
    w = bounds.whole
    out[:, :w] = np.sign(out[:, :w]) * np.floor(np.abs(out[:, :w]) + 0.5)
    low, high = np.array(bounds.low), np.array(bounds.high)
    excess = np.maximum(out - high, 0) + np.maximum(low - out, 0)
    return np.clip(out, low, high), 1e10 * excess.sum(axis=1)


def differential_evolution(
    evaluate: Evaluate, bounds: Bounds, population: int = 100, generations: int = 200, over_init: int = 0,
    weight: float = 0.6, crossover: float = 0.5, climb: float = 0.2, patience: int = 30, seed: int = 1,
    relax: Callable[[], None] | None = None, failures: int = 500,
) -> tuple[np.ndarray, float, list[tuple[np.ndarray, np.ndarray]]]:
    """(best point, its value, all evaluated generations): rand/1/bin with hill climbing of children.

    A generation's children, and its climbing steps, are each one call of
    ``evaluate``, hence one job. Criteria must be positive to count as found:
    members of the first generation that are not are drawn again, and ``relax`` is
    called after so many ``failures`` in a row.
    """
    return in_step(lambda asked: {k: evaluate(points) for k, points in asked.items()}, {0: evolution(bounds, population, generations, over_init, weight, crossover, climb, patience, seed, relax, failures)})[0]


def in_step(evaluate: Callable[[dict[Hashable, np.ndarray]], dict[Hashable, np.ndarray]], searches: dict[Hashable, Search]) -> dict[Hashable, tuple]:
    """What each search returns; what they ask for is evaluated step by step, for all of them in one call."""
    asked, found = {}, {}

    def go_on(key: Hashable, values: np.ndarray | None) -> None:
        try:
            asked[key] = searches[key].send(values)
        except StopIteration as end:
            asked.pop(key, None)
            found[key] = end.value

    for key in searches:
        go_on(key, None)
    while asked:
        for key, values in evaluate(dict(asked)).items():
            go_on(key, values)
    return found


def shifted(search: Search, by: float) -> Search:
    """``search`` with ``by`` added to all values that it gets."""
    values = None
    while True:
        try:
            values = (yield search.send(values)) + by
        except StopIteration as end:
            return end.value


def evolution(
    bounds: Bounds, population: int = 100, generations: int = 200, over_init: int = 0,
    weight: float = 0.6, crossover: float = 0.5, climb: float = 0.2, patience: int = 30, seed: int = 1,
    relax: Callable[[], None] | None = None, failures: int = 500,
) -> Search:
    """``differential_evolution`` as a search that others can run in step with."""
    rng = np.random.default_rng(seed)
    low, high = np.array(bounds.low), np.array(bounds.high)
    d = len(low)

    def valued(points: np.ndarray) -> Search:
        legal, penalty = legalize(points, bounds)
        values = (yield legal) - penalty
        seen.append((legal, values))
        return legal, values

    seen: list[tuple[np.ndarray, np.ndarray]] = []
    pool, values = yield from valued(rng.uniform(low, high, (population + over_init, d)))
    in_a_row, fresh = 0, values
    for _ in range(10 if relax is None else 1 + 20 * failures // population):
        for value in fresh:
            in_a_row = 0 if value > 0 else in_a_row + 1
            if relax is not None and in_a_row == failures:
                relax()
                in_a_row = 0
        bad = values <= 0
        if not bad.any():
            break
        pool[bad], values[bad] = yield from valued(rng.uniform(low, high, (int(bad.sum()), d)))
        fresh = values[bad]
    keep = np.argsort(-values, kind="stable")[:population]
    pool, values = pool[keep], values[keep]
    stale = 0
    for _ in range(generations):
        picks = np.array([rng.choice(population - 1, 3, replace=False) for _ in range(population)])
        picks += picks >= np.arange(population)[:, None]  # three others
        a, b, c = (pool[picks[:, k]] for k in range(3))
        cross = rng.random((population, d)) < crossover
        cross[np.arange(population), rng.integers(d, size=population)] = True
        children, got = yield from valued(np.where(cross, a + weight * (b - c), pool))
        if climb:
            which, var = rng.random(population) < climb, rng.integers(d, size=population)
            step = np.where(var < bounds.whole, 1.0, 0.02 * (high - low)[var] * rng.random(population))
            step *= rng.choice([-1.0, 1.0], population)
            trial = children[which].copy()
            if len(trial):
                trial[np.arange(len(trial)), var[which]] += step[which]
                trial, better = yield from valued(trial)
                up = better > got[which]
                at = np.flatnonzero(which)[up]
                children[at], got[at] = trial[up], better[up]
        best_before = values.max()
        won = got > values
        pool[won], values[won] = children[won], got[won]
        stale = 0 if values.max() > best_before else stale + 1
        if stale >= patience:
            break
    top = int(values.argmax())
    return pool[top], float(values[top]), seen


def global_max(f: Callable[[float], float], low: float, high: float, points: int = 20, log: bool = False, expand: int = 5) -> tuple[tuple[float, float], ...]:
    """Three points around a maximum: an even scan that grows threefold while an end is best."""
    for _ in range(expand):
        xs = np.geomspace(low, high, points) if log else np.linspace(low, high, points)
        ys = [f(float(x)) for x in xs]
        k = int(np.argmax(ys))
        if 0 < k < points - 1:
            break
        if k == 0:
            low = low / 3 if log else low - (high - low)
        else:
            high = high * 3 if log else high + (high - low)
    k = min(max(k, 1), points - 2)
    return tuple((float(xs[j]), float(ys[j])) for j in (k - 1, k, k + 1))


def brent_max(f: Callable[[float], float], low: float, mid: float, high: float, tol: float = 1e-8, most: int = 100) -> tuple[float, float]:
    """(place, value) of a maximum within a bracket, by parabolas where they help and golden sections elsewhere."""
    gold = 0.3819660112501051
    x = w = v = mid
    fx = fw = fv = f(x)
    step = last = 0.0
    for _ in range(most):
        centre = 0.5 * (low + high)
        eps = tol * abs(x) + 1e-12
        if abs(x - centre) <= 2 * eps - 0.5 * (high - low):
            break
        golden = True
        if abs(last) > eps:
            r, q = (x - w) * (fx - fv), (x - v) * (fx - fw)
            p, q = (x - v) * q - (x - w) * r, 2 * (q - r)
            p, q = (-p, q) if q > 0 else (p, -q)
            if abs(p) < abs(0.5 * q * last) and q * (low - x) < p < q * (high - x):
                last, step, golden = step, p / q, False
        if golden:
            last = (high if x < centre else low) - x
            step = gold * last
        u = x + (step if abs(step) >= eps else (eps if step > 0 else -eps))
        fu = f(u)
        if fu >= fx:
            low, high = (x, high) if u >= x else (low, x)
            v, fv, w, fw, x, fx = w, fw, x, fx, u, fu
        else:
            low, high = (u, high) if u < x else (low, u)
            if fu >= fw or w == x:
                v, fv, w, fw = w, fw, u, fu
            elif fu >= fv or v in (x, w):
                v, fv = u, fu
    return x, fx


def sensitivity(evaluate: Evaluate, best: Sequence[float], bounds: Bounds, points: int = 20) -> list[tuple[int, float, float]]:
    """(parameter, value, criterion): each parameter over its range, the others at the best, all in one call."""
    return in_step(lambda asked: {k: evaluate(p) for k, p in asked.items()}, {0: curves(best, bounds, points)})[0]


def curves(best: Sequence[float], bounds: Bounds, points: int = 20) -> Search:
    """``sensitivity`` as a search of one step."""
    rows, where = [], []
    for k, (lo, hi) in enumerate(zip(bounds.low, bounds.high, strict=True)):
        values = np.unique(np.floor(np.linspace(lo, hi, points) + 0.5)) if k < bounds.whole else np.linspace(lo, hi, points)
        for value in values:
            point = np.array(best, dtype=float)
            point[k] = value
            rows.append(point)
            where.append((k, float(value)))
    return [(k, value, float(y)) for (k, value), y in zip(where, (yield np.array(rows)), strict=True)]


def histogram(curve: list[tuple[int, float, float]], width: int = 60) -> str:
    """The curves as lines of stars, each scaled to its own best."""
    lines, tops = [], {}
    for k, _, y in curve:
        tops[k] = max(tops.get(k, 1e-30), y)
    for k, value, y in curve:
        lines.append(f"{k:2d} {value:12.4f} {y:14.6f} |" + "*" * max(0, int(width * y / tops[k])))
    return "\n".join(lines)


def nearest(points: np.ndarray, values: np.ndarray, factor: float = 1.5) -> tuple[np.ndarray, np.ndarray]:
    """The best point and those nearest to it, as many as a quadratic needs times ``factor``."""
    d = points.shape[1]
    need = int(factor * ((d + 1) * (d + 2) // 2))
    best = points[values.argmax()]
    spread = points.std(axis=0) + 1e-30
    order = np.argsort((((points - best) / spread) ** 2).sum(axis=1), kind="stable")[:need]
    return points[order], values[order]


def parameter_correlation(points: np.ndarray, values: np.ndarray) -> dict:
    """Covariances of parameters near the optimum from a quadratic fit, and the directions of least and most effect."""
    points, values = nearest(points, values)
    d = points.shape[1]
    centre = points[values.argmax()]
    scale = points.std(axis=0) + 1e-30
    z = (points - centre) / scale
    at = [(a, b) for a in range(d) for b in range(a, d)]
    design = np.column_stack([np.ones(len(z)), z, *[z[:, a] * z[:, b] for a, b in at]])
    coef = np.linalg.lstsq(design, values, rcond=None)[0][1 + d :]
    hessian = np.zeros((d, d))
    for c, (a, b) in zip(coef, at, strict=True):
        hessian[a, b] += -c
        hessian[b, a] += -c
    roots, vectors = np.linalg.eigh(hessian)
    roots = np.maximum(roots, 0)  # a maximum bends down everywhere
    cov = vectors @ np.diag(np.where(roots > 1e-12 * max(roots.max(), 1e-300), 1 / np.maximum(roots, 1e-300), 0)) @ vectors.T
    dev = np.sqrt(np.maximum(np.diag(cov), 0)) + 1e-300
    order = np.argsort(-roots)
    return {"hessian": hessian, "correlation": cov / np.outer(dev, dev), "deviation": dev * scale, "most": vectors[:, order[0]] * scale, "least": vectors[:, order[-1]] * scale}


def solve(matrix: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Gaussian elimination with pivoting."""
    return np.linalg.solve(matrix, right)


def sphere(p: np.ndarray) -> np.ndarray:
    return 100.0 - (p**2).sum(axis=1)


def rosenbrock(p: np.ndarray) -> np.ndarray:
    return 1000.0 - (100 * (p[:, 1:] - p[:, :-1] ** 2) ** 2 + (1 - p[:, :-1]) ** 2).sum(axis=1)


class ThresholdSystems:
    """Total returns of (long lookback, short %, short threshold, long threshold) on each market, for ``in_step``.

    The series' means are worked out once and kept; what all markets ask for is a
    small relation that meets each bar of its market and is folded per candidate, in
    one job. A candidate with fewer than ``least`` trades of its market has failed.
    """

    def __init__(self, bars: DataFrame, most: int, least: int = 1, x: str = "x"):
        from . import grids
        from .indicators import MARKET

        held = grids.with_means(bars, x, most, MARKET).withColumn("_next", F.lead(x).over(Window.partitionBy("symbol").orderBy("i")) - F.col(x))
        held = kept(held.select("symbol", "i", "m", "_next"), "means")
        self.symbols = sorted(r["symbol"] for r in held.select("symbol").distinct().collect())
        self._held = held.where(F.col("_next").isNotNull() & (F.col("i") >= most - 1)).select("symbol", "m", "_next")
        self.least = dict.fromkeys(self.symbols, least)

    def relax(self, symbol: str) -> None:
        """A tenth fewer trades are asked for, one at least."""
        self.least[symbol] = max(1, self.least[symbol] * 9 // 10)

    def __call__(self, asked: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        cells = []
        for symbol, points in asked.items():
            long = points[:, 0].astype(int)
            short = np.clip((0.01 * points[:, 1] * long).astype(int), 1, np.maximum(long - 1, 1))
            cells.append(pd.DataFrame({"symbol": symbol, "k": np.arange(len(points)), "a": short, "b": long, "s": points[:, 2] / 1e4, "t": points[:, 3] / 1e4}))
        relation = self._held.sparkSession.createDataFrame(pa.Table.from_pandas(pd.concat(cells), preserve_index=False))
        out = same(["symbol"], self._held, F.broadcast(relation))
        change = F.try_divide(F.element_at("m", F.col("a").cast("int")), F.element_at("m", F.col("b").cast("int"))) - 1
        signal = F.when(change > F.col("t"), 1).when(change < -F.col("s"), -1).otherwise(0)
        found = out.groupBy("symbol", "k").agg(F.sum(signal * F.col("_next")).alias("total"), F.sum(F.abs(signal)).alias("trades")).collect()
        values = {symbol: np.full(len(points), -1e20) for symbol, points in asked.items()}
        for r in found:
            if r["trades"] >= self.least[r["symbol"]]:
                values[r["symbol"]][r["k"]] = r["total"]
        return values
