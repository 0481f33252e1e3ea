"""Statistics of a user's own in bootstrap, jackknife and cross-validation, by a contract that lets states be added up and taken apart.

A statistic says what an empty state is, how values enter it, how two states
become one, how values or a whole state leave it again, and its value. So a
resample is one pass over counts of how often each value was drawn, a
leave-one-out value is the whole less one, and a fold's training state is the
whole less the fold: nothing is made a row for each sample and sample.
"""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator, Mapping, Sequence
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import resample
from .ordered import same
from .replicate import bits, chunks, series_of


class Statistic(ABC):
    """What a statistic must offer; states may be any object that can be pickled."""

    @abstractmethod
    def zero(self) -> Any:
        """The state of no values."""

    @abstractmethod
    def add(self, state: Any, values: np.ndarray, times: np.ndarray | None = None) -> Any:
        """``state`` with values, each so many times (once if not said)."""

    @abstractmethod
    def merge(self, a: Any, b: Any) -> Any:
        """The state of the values of both."""

    @abstractmethod
    def retract(self, whole: Any, part: Any) -> Any:
        """``whole`` without the values of ``part``, which it holds."""

    @abstractmethod
    def value(self, state: Any) -> float: ...

    def left_out(self, whole: Any, values: np.ndarray) -> np.ndarray:
        """The statistic without each of the values in turn."""
        return np.array([self.value(self.retract(whole, self.add(self.zero(), values[k : k + 1]))) for k in range(len(values))])


class Sums(Statistic):
    """A statistic that is a function of sums: ``features`` turns n values into n rows of numbers, ``of`` turns their sums (last axis) into the value."""

    def __init__(self, features: Callable[[np.ndarray], np.ndarray], of: Callable[[np.ndarray], np.ndarray]):
        self.features, self.of = features, of

    def zero(self) -> np.ndarray:
        return self.features(np.empty(0)).sum(axis=0)

    def add(self, state, values, times=None):
        rows = self.features(values)
        return state + (rows.sum(axis=0) if times is None else times @ rows)

    def merge(self, a, b):
        return a + b

    def retract(self, whole, part):
        return whole - part

    def value(self, state) -> float:
        return float(self.of(state))

    def left_out(self, whole, values):
        return self.of(whole - self.features(values))


def _sharpe(s: np.ndarray) -> np.ndarray:
    mean = s[..., 1] / s[..., 0]
    return mean / (np.sqrt(np.maximum(s[..., 2] / s[..., 0] - mean * mean, 0.0)) + 1e-60)


SHARPE = Sums(lambda x: np.stack([np.ones_like(x), x, x * x], axis=1), _sharpe)
PROFIT_FACTOR = Sums(lambda x: np.stack([np.maximum(x, 0.0), np.maximum(-x, 0.0)], axis=1), lambda s: (s[..., 0] + 1e-60) / (s[..., 1] + 1e-60))
MEAN = Sums(lambda x: np.stack([np.ones_like(x), x], axis=1), lambda s: s[..., 1] / s[..., 0])


def _rows(df: DataFrame, run: Callable[[np.ndarray, dict], list[tuple]], by: Sequence[str], schema: str) -> DataFrame:
    """``by`` and ``schema``: what ``run`` makes of each row's ``values``, a row of keys at a time."""
    kinds = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "string": pa.string()}
    columns = [c.split() for c in schema.split(", ")]

    def batches_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                part = batch.slice(k, 1)
                row = part.to_pylist()[0]
                out = run(np.array(row["values"], float), row)
                if out:
                    keys = [pa.array([row[c]] * len(out), part.schema.field(c).type) for c in by]
                    yield pa.RecordBatch.from_arrays([*keys, *(pa.array(v, kinds[t]) for v, (_, t) in zip(zip(*out, strict=True), columns, strict=True))], names=[*by, *(n for n, _ in columns)])

    types = {f.name: f.dataType.simpleString() for f in df.schema}
    return df.mapInArrow(batches_of, ", ".join([*(f"`{c}` {types[c]}" for c in by), schema]))


def _held(df: DataFrame, x: str, by: Sequence[str], i: str) -> DataFrame:
    return series_of(df.where(F.col(x).isNotNull()), by, x, i)


def bootstrap(df: DataFrame, statistics: Mapping[str, Statistic], x: str, by: Sequence[str], i: str, reps: int, seed: int) -> DataFrame:
    """``by, statistic, rep, stat`` of each resample; all statistics see the same draws, those of ``resample.draws``."""

    def run(values: np.ndarray, row: dict) -> list[tuple]:
        n, out = len(values), []
        for rep in range(row["first"], row["last"]):
            times = np.bincount(bits(seed, [rep], n) % n, minlength=n).astype(float)
            out += [(name, rep, s.value(s.add(s.zero(), values, times))) for name, s in statistics.items()]
        return out

    return _rows(chunks(_held(df, x, by, i), reps), run, list(by), "statistic string, rep int, stat double")


def jackknife(df: DataFrame, statistics: Mapping[str, Statistic], x: str, by: Sequence[str], i: str) -> DataFrame:
    """``by, statistic, theta, accel``: the value of all, and the skewness of the leave-one-out values that BCa calls acceleration."""

    def run(values: np.ndarray, row: dict) -> list[tuple]:
        out = []
        for name, s in statistics.items():
            whole = s.add(s.zero(), values)
            left = s.left_out(whole, values) if len(values) > 1 else np.zeros(1)
            apart = left.mean() - left
            out.append((name, s.value(whole), float((apart**3).sum() / (6 * np.sqrt((apart**2).sum()) ** 3 + 1e-60))))
        return out

    return _rows(_held(df, x, by, i), run, list(by), "statistic string, theta double, accel double")


def bca(df: DataFrame, statistics: Mapping[str, Statistic], x: str, by: Sequence[str], i: str, reps: int, seed: int, probs: Sequence[float] = (0.025, 0.05, 0.10)) -> DataFrame:
    """``by, statistic, prob, low, high``: BCa bounds of any statistics of each series.

    ``i`` orders a series; null values do not count, a series without any has no
    row, one of a single value has it as both bounds.
    """
    keys = [*by, "statistic"]
    sorted_ = bootstrap(df, statistics, x, by, i, reps, seed).groupBy(*keys).agg(F.array_sort(F.collect_list("stat")).alias("s"))
    held = same(keys, sorted_, jackknife(df, statistics, x, by, i))
    return resample.bca(held.select("*", F.explode(F.array(*[F.lit(p) for p in probs])).alias("prob")), [*keys, "prob"])


def cross_validated(df: DataFrame, statistics: Mapping[str, Statistic], x: str, by: Sequence[str], i: str, folds: int) -> DataFrame:
    """``by, statistic, fold, inside, outside``: the value of each of ``folds`` stretches of a series, and of all but it."""

    def run(values: np.ndarray, row: dict) -> list[tuple]:
        out = []
        parts = [p for p in np.array_split(values, folds) if len(p)]
        for name, s in statistics.items():
            states = [s.add(s.zero(), p) for p in parts]
            whole = s.zero()
            for state in states:
                whole = s.merge(whole, state)
            out += [(name, k, s.value(state), s.value(s.retract(whole, state))) for k, state in enumerate(states)]
        return out

    return _rows(_held(df, x, by, i), run, list(by), "statistic string, fold int, inside double, outside double")
