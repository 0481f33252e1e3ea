"""Replications worked through in tasks as arrays: permutation tests and nested drawdown bounds at thousands of replications.

A task gets a series, once, and a range of replications; what it gives back are a
replication's totals. No row stands for a bar of a replication. Series are bars,
which calendar time bounds.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rng

#: Replications that a task's row names, and bars whose pairs are worked out at once.
CHUNK, BARS = 16, 2048


def bits(seed: int, parts: Sequence, n: int) -> np.ndarray:
    """``rng.bits(seed, *parts, 0..n-1)`` as an array."""
    head = ":".join([str(seed), *map(str, parts), ""]).encode()
    digits = rng.BITS // 4
    return np.array([int(md5(head + str(k).encode()).hexdigest()[:digits], 16) for k in range(n)], np.int64)


def chunks(held: DataFrame, reps: int, size: int = CHUNK) -> DataFrame:
    """A row for each of ``held`` and each ``size`` replications, ``first`` to ``last``, dealt out to tasks."""
    starts = F.explode(F.sequence(F.lit(0), F.lit(reps - 1), F.lit(size))).alias("first")
    rows = held.select("*", starts).withColumn("last", F.least(F.col("first") + size, F.lit(reps)))
    tasks = min(4 * held.sparkSession.sparkContext.defaultParallelism, max(1, -(-reps // size)))
    return rows.repartition(tasks)


def series_of(df: DataFrame, by: Sequence[str], x: str, i: str) -> DataFrame:
    """``by, values``: each series as one array in order of ``i``."""
    return df.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col(i).alias("i"), F.col(x).cast("double").alias("x")))).alias("_s")).select(*by, F.transform("_s", lambda s: s["x"]).alias("values"))


# --- crossover permutation test -------------------------------------------------------------------


def crossover_totals(x: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Totals, and long bars less short ones, of all pairs of lookbacks in loop order, over bars from ``most`` - 1 on.

    Blocks of bars are folded into the two arrays; what a block needs of the bars
    before are the running sums of the last ``most`` of them.
    """
    found = np.zeros((most * (most - 1) // 2, 2))
    upto = np.concatenate([[0.0], np.cumsum(x - x[0])])
    for lo in range(most - 1, len(x) - 1, BARS):
        at = np.arange(lo, min(lo + BARS, len(x) - 1))
        means = np.stack([(upto[at + 1] - upto[at + 1 - k]) / k for k in range(1, most + 1)])
        side = np.empty((len(found), len(at)))
        row = 0
        for long in range(1, most):
            np.subtract(means[:long], means[long], out=side[row : row + long])
            row += long
        np.sign(side, out=side)
        found += side @ np.stack([x[at + 1] - x[at], np.ones(len(at))], axis=1)
    return found[:, 0], found[:, 1].astype(np.int64)


def shuffled(x: np.ndarray, first: int, order: np.ndarray | None) -> np.ndarray:
    """``x`` with its changes after bar ``first`` in the order of random numbers."""
    step = np.diff(x)[first:]
    step = step if order is None else step[np.argsort(order, kind="stable")]
    return np.concatenate([x[: first + 1], x[first] + np.cumsum(step)])


def _tested(by: int, most: int, seed: int, kinds: list[pa.DataType]):
    names = [f"k{k}" for k in range(by)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                x, out = np.array(row["values"], float), []
                keys = [row[n] for n in names]
                for rep in range(row["first"], row["last"]):
                    order = bits(seed, [*keys, rep], len(x))[most:] if rep else None
                    total, net = crossover_totals(shuffled(x, most - 1, order), most)
                    best = int(np.argmax(np.round(total, 10)))  # of equal ones the first in loop order
                    out.append((*keys, rep, total[best], net[best]))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), [*kinds, pa.int32(), pa.float64(), pa.int64()], strict=True)], names=[*names, "rep", "total", "net"])

    return run


def best_crossovers(df: DataFrame, by: Sequence[str], x: str, i: str, most: int, reps: int, seed: int) -> DataFrame:
    """``by, rep, total, net`` (long bars less short ones) of the best pair of each replication; 0 is the data, others have their changes after bar ``most`` - 1 in random order.

    Series with fewer than ``most`` + 1 bars give no rows.
    """
    by = list(by)
    held = series_of(df, by, x, i).where(F.size("values") > most)
    kinds = {f.name: f.dataType.simpleString() for f in held.schema}
    arrow = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "date": pa.date32()}
    rows = chunks(held.select(*[F.col(c).alias(f"k{k}") for k, c in enumerate(by)], "values"), reps)
    schema = ", ".join([*[f"k{k} {kinds[c]}" for k, c in enumerate(by)], "rep int, total double, net long"])
    found = rows.mapInArrow(_tested(len(by), most, seed, [arrow[kinds[c]] for c in by]), schema)
    return found.withColumnsRenamed({f"k{k}": c for k, c in enumerate(by)})


# --- falls from a peak -----------------------------------------------------------------------------


@dataclass(frozen=True)
class Fall:
    """What is to be known of a stretch of changes: their sum, the highest and lowest sum of a beginning of it, and the worst fall from a peak within it.

    The peak is the sum at some bar of it, the first at the earliest. Numbers or arrays, one for each path.
    """

    total: np.ndarray
    high: np.ndarray
    low: np.ndarray
    worst: np.ndarray

    def then(self, after: Fall) -> Fall:
        """Of this stretch and the one that follows; stretches may be joined in any grouping."""
        low = self.total + after.low
        return Fall(self.total + after.total, np.maximum(self.high, self.total + after.high), np.minimum(self.low, low), np.maximum(np.maximum(self.worst, after.worst), self.high - low))


def fall_of(changes: np.ndarray) -> Fall:
    """Of the changes along the first axis, bar by bar over all paths at once."""
    total = np.array(changes[0], float)
    high, low, worst, fall = total.copy(), total.copy(), np.zeros_like(total), np.empty_like(total)
    for change in changes[1:]:
        total += change
        np.maximum(high, total, out=high)
        np.minimum(low, total, out=low)
        np.subtract(high, total, out=fall)
        np.maximum(worst, fall, out=worst)
    return Fall(total, high, low, worst)


#: Where no bar is: joined to any stretch it changes nothing.
NOTHING = Fall(np.float64(0.0), np.float64(-np.inf), np.float64(np.inf), np.float64(0.0))


def places(seed: int, parts: Sequence, paths: range, size: int, n: int, hashed: bool) -> Iterator[np.ndarray]:
    """Drawn places 0 to n-1, some bars (first axis) of all ``paths`` at a time; by the engine-neutral hash, or much faster by a counter generator with the same keys."""
    if hashed:
        yield np.stack([bits(seed, [*parts, b], size) % n for b in paths], axis=1)
        return
    draw = np.random.Generator(np.random.Philox(key=int.from_bytes(md5(":".join(map(str, [seed, *parts, paths.start])).encode()).digest(), "big")))
    for lo in range(0, size, 64):
        yield draw.integers(0, n, (min(64, size - lo), len(paths)), dtype=np.int32)


def worst_falls(values: np.ndarray, seed: int, parts: Sequence, inner: int, size: int, hashed: bool, at_once: int = 10_000) -> np.ndarray:
    """The worst fall of each of ``inner`` resampled paths of ``size`` changes; paths stream, only their ``Fall`` is held."""
    found = []
    for lo in range(0, inner, at_once):
        now = NOTHING
        for at in places(seed, parts, range(lo, min(lo + at_once, inner)), size, len(values), hashed):
            now = now.then(fall_of(values[at]))
        found.append(now.worst)
    return np.concatenate(found)


def order_places(n: int, probs: Sequence[float]) -> np.ndarray:
    """Places from 0 of the order statistics floor(prob (n + 1)), clamped."""
    return np.clip(np.floor(np.array(probs) * (n + 1)).astype(int) - 1, 0, n - 1)


def nested_drawdowns(df: DataFrame, x: str, i: str, reps: int, inner: int, size: int, seed: int, probs: Sequence[float], hashed: bool = True) -> DataFrame:
    """``rep, prob, drawdown``: for each resample of a series the quantiles of the worst drawdown, in percent, of ``inner`` paths of ``size`` changes drawn from it.

    ``df`` is one series of bars with places ``i`` from 0. Replications are dealt
    out; a row comes back for each of them and each probability.
    """
    held = chunks(series_of(df.select(F.lit(0).alias("_one"), x, i), ["_one"], x, i), reps, max(1, min(CHUNK, 2_000_000 // max(1, inner * size))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                values, rep_of, prob_of, out = np.array(row["values"], float), [], [], []
                for rep in range(row["first"], row["last"]):
                    n = len(values)
                    sample = values[bits(seed, [rep], n) % n]
                    falls = np.sort((1.0 - np.exp(-worst_falls(sample, seed + 1, [rep], inner, size, hashed))) * 100)
                    rep_of += [rep] * len(probs)
                    prob_of += list(probs)
                    out.append(falls[order_places(inner, probs)])
                yield pa.RecordBatch.from_arrays([pa.array(rep_of, pa.int32()), pa.array(prob_of, pa.float64()), pa.array(np.concatenate(out))], names=["rep", "prob", "drawdown"])

    return held.mapInArrow(run, "rep int, prob double, drawdown double")
