"""Elastic nets of all markets at once: one mergeable aggregate of moments, solved by market in grouped workers.

A task folds the rows it has into a state for each market and block, an array of
count, means and centred cross-products; states are all that is shuffled. Two
states add up exactly as if their rows had been one set, about their common mean,
so sums of squares do not cancel. A market's worker merges its states, which are
few, and solves on p x p numbers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import models

#: States that a task holds before it passes them on.
HELD = 4096


class State:
    """Count, means and centred cross-products of rows of several columns, the target last."""

    def __init__(self, n: float, mean: np.ndarray, products: np.ndarray):
        self.n, self.mean, self.products = n, mean, products

    @classmethod
    def of(cls, rows: np.ndarray) -> State:
        mean = rows.mean(axis=0)
        centred = rows - mean
        return cls(float(len(rows)), mean, centred.T @ centred)

    def __add__(self, other: State) -> State:
        n = self.n + other.n
        apart = other.mean - self.mean
        return State(n, self.mean + apart * (other.n / n), self.products + other.products + np.outer(apart, apart) * (self.n * other.n / n))

    def moments(self, pivot: np.ndarray) -> models.Moments:
        """The sums that the solver takes, about ``pivot``."""
        gone = self.mean - pivot
        sums, products = self.n * gone, self.products + self.n * np.outer(gone, gone)
        return models.Moments(self.n, sums[:-1], products[:-1, :-1], products[:-1, -1], float(sums[-1]), float(products[-1, -1]), pivot)


def _folded(width: int):
    names = ["by", "block", "n", "mean", "products"]

    def batch_of(held: dict) -> pa.RecordBatch:
        rows = [(by, block, s.n, s.mean.tolist(), s.products.ravel().tolist()) for (by, block), s in held.items()]
        kinds = [pa.string(), pa.int32(), pa.float64(), pa.list_(pa.float64()), pa.list_(pa.float64())]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, State] = {}
        for batch in batches:
            frame = batch.to_pandas()
            for key, rows in frame.groupby(["by", "block"], sort=False, dropna=False):
                found = State.of(rows.iloc[:, 2 : 2 + width].to_numpy(dtype=float))
                held[key] = held[key] + found if key in held else found
            if len(held) >= HELD:
                yield batch_of(held)
                held = {}
        if held:
            yield batch_of(held)

    return run


def states(df: DataFrame, features: list[str], target: str, by: str = "symbol", block: Column | None = None) -> DataFrame:
    """``by, block, n, mean, products``: a state for each task, market and block; rows with a null do not count."""
    columns = [*features, target]
    block = F.lit(0) if block is None else block
    rows = df.select(F.col(by).cast("string").alias("by"), block.cast("int").alias("block"), *[F.col(c).cast("double").alias(f"c{k}") for k, c in enumerate(columns)])
    return rows.dropna().mapInArrow(_folded(len(columns)), "by string, block int, n double, mean array<double>, products array<double>")


def merged(rows: pd.DataFrame) -> dict[int, models.Moments]:
    """One market's moments by block, all about the market's means."""
    found: dict[int, State] = {}
    for block, n, mean, products in zip(rows["block"], rows["n"], rows["mean"], rows["products"], strict=True):
        state = State(n, np.asarray(mean, float), np.asarray(products, float).reshape(len(mean), -1))
        found[block] = found[block] + state if block in found else state
    whole = None
    for state in found.values():
        whole = state if whole is None else whole + state
    return {block: found[block].moments(whole.mean) for block in sorted(found)}


def solved(held: DataFrame, solve: Callable[[dict[int, models.Moments]], list[tuple]], columns: str, by: str = "symbol") -> DataFrame:
    """``by`` and ``columns``: what ``solve`` makes of each market's moments, markets side by side."""
    names = [c.split()[0] for c in columns.split(", ")]

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(rows["by"].iloc[0], *r) for r in solve(merged(rows))], columns=["by", *names])

    # markets are few and dear: so many partitions as the session has, however little they hold
    spread = held.repartition(int(held.sparkSession.conf.get("spark.sql.shuffle.partitions")), "by")
    return spread.groupBy("by").applyInPandas(run, f"by string, {columns}").withColumnRenamed("by", by)


MODEL = "beta array<double>, xmeans array<double>, xscales array<double>, ymean double, yscale double, explained double, lam double"


def fitted(df: DataFrame, features: list[str], target: str, alpha: float = 0.5, by: str = "symbol", block: Column | None = None, steps: int = 50, eps: float = 1e-7, most: int = 1000) -> DataFrame:
    """``by`` and a model (``MODEL``) of each market: the penalty by cross-validation over ``block`` (none: 0), then the final fit."""
    if not 0 <= alpha <= 1:
        raise ValueError("alpha must lie in [0, 1]")

    def solve(blocks: dict[int, models.Moments]) -> list[tuple]:
        m = models.of_blocks(blocks, alpha, steps, eps, most)
        return [(m.beta, m.xmeans, m.xscales, m.ymean, m.yscale, m.explained, m.lam)]

    return solved(states(df, features, target, by, block), solve, MODEL, by)


def penalties(df: DataFrame, features: list[str], target: str, alpha: float, by: str, block: Column, steps: int = 50, eps: float = 1e-7, most: int = 1000) -> DataFrame:
    """``by, lam, explained, chosen``: the share of held-out squares that each penalty explains over the folds of ``block``."""

    def solve(blocks: dict[int, models.Moments]) -> list[tuple]:
        if len(blocks) < 2:
            return []
        best, lams, explained = models.cross_validate(blocks, alpha, steps, eps, most)
        return [(float(a), float(e), bool(a == best)) for a, e in zip(lams, explained, strict=True)]

    return solved(states(df, features, target, by, block), solve, "lam double, explained double, chosen boolean", by)


def paths(df: DataFrame, features: list[str], target: str, alpha: float = 0.5, by: str = "symbol", steps: int = 50, eps: float = 1e-9, most: int = 1000) -> DataFrame:
    """``by, lam, beta``: the coefficients of each market along falling penalties."""

    def solve(blocks: dict[int, models.Moments]) -> list[tuple]:
        total = models.total_of(blocks)
        return [(float(lam), beta.tolist()) for lam, beta in zip(*models.path(*models.standardized(total)[:2], alpha, steps, eps, most), strict=True)]

    return solved(states(df, features, target, by), solve, "lam double, beta array<double>", by)


def predicted(df: DataFrame, found: DataFrame, features: list[str], by: str = "symbol") -> DataFrame:
    """``df`` with ``pred`` by the model of its market; null where a feature is null or the market has no model."""
    model = found.withColumnRenamed(by, "_by")
    part = lambda c, k: F.get(F.col(c), F.lit(k))
    terms = [(F.col(f) - part("xmeans", k)) / part("xscales", k) * part("beta", k) for k, f in enumerate(features)]
    value = sum(terms, F.lit(0.0)) * F.col("yscale") + F.col("ymean")
    met = df.join(model, F.col(by) == F.col("_by"), "left")
    return met.select(*df.columns, value.alias("pred"))
