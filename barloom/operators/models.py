"""Elastic net by coordinate descent over moments that one pass of Spark gathers."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class Moments:
    """Count, sums, cross-products of features and target: all that the solver needs, and additive over blocks.

    Values are taken from ``pivot`` (of the features, then the target), which all
    blocks share, so that sums of squares do not cancel. ``weighted`` has the same sums of weighted cases.
    """

    n: float
    sx: np.ndarray
    sxx: np.ndarray
    sxy: np.ndarray
    sy: float
    syy: float
    pivot: np.ndarray
    weighted: Moments | None = None

    def _with(self, other: Moments, sign: int) -> Moments:
        sums = [getattr(self, k) + sign * getattr(other, k) for k in ("n", "sx", "sxx", "sxy", "sy", "syy")]
        return Moments(*sums, self.pivot, self.weighted._with(other.weighted, sign) if self.weighted else None)

    def __sub__(self, other: Moments) -> Moments:
        return self._with(other, -1)

    def __add__(self, other: Moments) -> Moments:
        return self._with(other, 1)


def gather(df: DataFrame, features: list[str], target: str, block: str | None = None, weight: str | None = None) -> dict[int, Moments]:
    """Moments by block: an aggregate of means, then one of p (p + 3) / 2 + 3 sums a block, whatever the number of rows.

    With ``weight`` the sums of weighted cases are gathered beside them.
    """
    p = len(features)
    cells = [(a, b) for a in range(p) for b in range(a, p)]
    held = df.dropna(subset=[*features, target, *([weight] if weight else [])])
    pivot = np.array([v or 0.0 for v in held.agg(*[F.avg(c).alias(f"m{k}") for k, c in enumerate([*features, target])]).first()], dtype=float)
    x = [F.col(f) - F.lit(float(m)) for f, m in zip(features, pivot[:p], strict=True)]
    y = F.col(target) - F.lit(float(pivot[p]))

    def sums(w, name: str) -> list:
        out = [F.sum(w).alias(f"{name}n"), F.sum(w * y).alias(f"{name}sy"), F.sum(w * y * y).alias(f"{name}syy")]
        out += [F.sum(w * x[a]).alias(f"{name}sx{a}") for a in range(p)] + [F.sum(w * x[a] * y).alias(f"{name}sxy{a}") for a in range(p)]
        return out + [F.sum(w * x[a] * x[b]).alias(f"{name}s{a}_{b}") for a, b in cells]

    def moments(r, name: str, weighted: Moments | None = None) -> Moments:
        sxx = np.zeros((p, p))
        for a, b in cells:
            sxx[a, b] = sxx[b, a] = r[f"{name}s{a}_{b}"]
        return Moments(float(r[f"{name}n"]), np.array([r[f"{name}sx{a}"] for a in range(p)]), sxx, np.array([r[f"{name}sxy{a}"] for a in range(p)]), r[f"{name}sy"], r[f"{name}syy"], pivot, weighted)

    aggs = sums(F.lit(1.0), "") + (sums(F.col(weight), "w") if weight else [])
    rows = held.groupBy(F.col(block) if block else F.lit(0).alias("_block")).agg(*aggs).collect()  # one row a block
    return {r[0]: moments(r, "", moments(r, "w") if weight else None) for r in rows}


@dataclass
class Model:
    beta: list[float]
    xmeans: list[float]
    xscales: list[float]
    ymean: float
    yscale: float
    explained: float
    lam: float = 0.0

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def from_json(cls, text: str) -> Model:
        return cls(**json.loads(text))


def standardized(m: Moments) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, float, float]:
    """(Gram, correlations with the target, means, scales, target mean, target scale), all per case; means are from the pivot.

    Means and scales are those of unweighted cases; weights count in the products alone.
    """
    means, ymean = m.sx / m.n, m.sy / m.n
    scales = np.sqrt(np.maximum(np.diag(m.sxx) / m.n - means**2, 0)) + 1e-60
    yscale = float(np.sqrt(max(m.syy / m.n - ymean**2, 0)) + 1e-60)
    w = m.weighted or m
    gram = (w.sxx - np.outer(w.sx, means) - np.outer(means, w.sx) + w.n * np.outer(means, means)) / w.n / np.outer(scales, scales)
    xy = (w.sxy - means * w.sy - w.sx * ymean + w.n * means * ymean) / w.n / scales / yscale
    return gram, xy, means, scales, ymean, yscale


def descend(gram: np.ndarray, xy: np.ndarray, lam: float, alpha: float, beta: np.ndarray | None = None, eps: float = 1e-9, most: int = 1000) -> np.ndarray:
    """Coefficients of one penalty by covariance updates over an active set."""
    p = len(xy)
    beta = np.zeros(p) if beta is None else beta.copy()
    full = True
    for _ in range(most):
        change = 0.0
        for k in range(p) if full else np.flatnonzero(beta):
            rho = xy[k] - gram[k] @ beta + gram[k, k] * beta[k]
            new = np.sign(rho) * max(abs(rho) - lam * alpha, 0.0) / (gram[k, k] + lam * (1 - alpha) + 1e-300)
            change = max(change, abs(new - beta[k]))
            beta[k] = new
        if change < eps:
            if full:
                break
            full = True  # the active set is settled: look at all once more
        else:
            full = False
    return beta


def threshold(xy: np.ndarray, alpha: float) -> float:
    """The least penalty at which no feature enters."""
    return float(np.abs(xy).max() / (alpha + 1e-60))


def path(gram: np.ndarray, xy: np.ndarray, alpha: float, steps: int = 50, eps: float = 1e-9, most: int = 1000) -> tuple[np.ndarray, np.ndarray]:
    """(penalties from 0.999 to 0.001 of the threshold, coefficients of each), every one started from the last."""
    top = 0.999 * threshold(xy, alpha)
    lams = top * (0.001 / 0.999) ** (np.arange(steps) / max(1, steps - 1))
    betas, beta = [], None
    for lam in lams:
        beta = descend(gram, xy, lam, alpha, beta, eps, most)
        betas.append(beta)
    return lams, np.array(betas)


def unexplained(model_beta: np.ndarray, test: Moments, means: np.ndarray, scales: np.ndarray, ymean: float, yscale: float) -> tuple[float, float]:
    """(squared error, squared target) over held-out moments in the training scale."""
    b = model_beta / scales
    c = -float(b @ means)
    # z = (y - ymean)/yscale - (b.x + c)
    szz = (test.syy - 2 * ymean * test.sy + test.n * ymean**2) / yscale**2
    bx = float(b @ test.sxx @ b + 2 * c * (b @ test.sx) + test.n * c * c)
    cross = float((b @ test.sxy - ymean * (b @ test.sx) + c * (test.sy - test.n * ymean)) / yscale)
    return szz - 2 * cross + bx, szz


def cross_validate(blocks: dict[int, Moments], alpha: float, steps: int = 50, eps: float = 1e-9, most: int = 1000) -> tuple[float, np.ndarray, np.ndarray]:
    """(best penalty, penalties, explained share of each) over contiguous folds.

    A fold's training moments are the total less its block, so all folds share one pass over the data.
    """
    total = sum(blocks.values(), start=next(iter(blocks.values())) - next(iter(blocks.values())))
    lams, _ = path(*standardized(total)[:2], alpha, steps, 1e-3, 1)
    errors, squares = np.zeros(steps), 0.0
    for block in blocks.values():
        gram, xy, means, scales, ymean, yscale = standardized(total - block)
        beta = None
        for k, lam in enumerate(lams):
            beta = descend(gram, xy, lam, alpha, beta, eps, most)
            e, s = unexplained(beta, block, means, scales, ymean, yscale)
            errors[k] += e
        squares += s
    explained = 1 - errors / squares
    return float(lams[int(explained.argmax())]), lams, explained


def fit(df: DataFrame, features: list[str], target: str, alpha: float = 0.5, block: str | None = None, steps: int = 50, eps: float = 1e-7, most: int = 1000, weight: str | None = None) -> Model:
    """The penalty by cross-validation over ``block`` (none: 0), then the final fit; cases may have a ``weight``."""
    if not 0 <= alpha <= 1:
        raise ValueError("alpha must lie in [0, 1]")
    return of_blocks(gather(df, features, target, block, weight), alpha, steps, eps, most)


def total_of(blocks: dict[int, Moments]) -> Moments:
    return sum(blocks.values(), start=next(iter(blocks.values())) - next(iter(blocks.values())))


def of_blocks(blocks: dict[int, Moments], alpha: float, steps: int = 50, eps: float = 1e-7, most: int = 1000) -> Model:
    """The model of all blocks, its penalty by cross-validation over them."""
    total = total_of(blocks)
    lam = cross_validate(blocks, alpha, steps, eps, most)[0] if alpha > 0 and len(blocks) > 1 else 0.0
    gram, xy, means, scales, ymean, yscale = standardized(total)
    beta = descend(gram, xy, lam, alpha, None, eps, most)
    explained = float(2 * beta @ xy - beta @ gram @ beta)
    return Model(beta.tolist(), (means + total.pivot[:-1]).tolist(), scales.tolist(), float(ymean + total.pivot[-1]), yscale, explained, lam)
