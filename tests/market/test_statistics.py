import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.functions import rng
from barloom.operators import replicate, statistics


class Median(statistics.Statistic):
    """A statistic of no sums: its state is the sorted values."""

    def zero(self):
        return []

    def add(self, state, values, times=None):
        times = np.ones(len(values)) if times is None else times
        return sorted([*state, *np.repeat(values, times.astype(int)).tolist()])

    def merge(self, a, b):
        return sorted([*a, *b])

    def retract(self, whole, part):
        left = list(whole)
        for v in part:
            left.remove(v)
        return left

    def value(self, state):
        return float(np.median(state))


def sharpe(v):
    return v.mean() / (v.std() + 1e-60)


def factor(v):
    return (np.maximum(v, 0).sum() + 1e-60) / (np.maximum(-v, 0).sum() + 1e-60)


OWN = {"sharpe": statistics.SHARPE, "profit_factor": statistics.PROFIT_FACTOR, "mean": statistics.MEAN, "median": Median()}
PLAIN = {"sharpe": sharpe, "profit_factor": factor, "mean": np.mean, "median": np.median}


@pytest.fixture(scope="module")
def held():
    gen = np.random.default_rng(6)
    return {"A": gen.normal(0.1, 1, 40), "B": gen.normal(-0.1, 2, 17), None: gen.normal(0, 1, 9)}


@pytest.fixture(scope="module")
def frame(spark, held):
    rows = [(k, i, float(v)) for k, x in held.items() for i, v in enumerate(x)] + [("A", 99, None), ("none", 0, None)]
    return spark.createDataFrame(rows, "symbol string, i int, r double").repartition(5)


def test_resamples_are_those_drawn(frame, held):
    got = {(r.symbol, r.statistic, r.rep): r.stat for r in statistics.bootstrap(frame, OWN, "r", ["symbol"], "i", 20, 3).collect()}
    assert len(got) == 3 * 4 * 20
    for (symbol, name, rep), value in got.items():
        x = held[symbol]
        assert value == pytest.approx(PLAIN[name](x[replicate.bits(3, [rep], len(x)) % len(x)]), rel=1e-7, abs=1e-9)


def test_leave_one_out(frame, held):
    for r in statistics.jackknife(frame, OWN, "r", ["symbol"], "i").collect():
        x = held[r.symbol]
        left = np.array([PLAIN[r.statistic](np.delete(x, k)) for k in range(len(x))])
        apart = left.mean() - left
        assert r.theta == pytest.approx(PLAIN[r.statistic](x), rel=1e-7, abs=1e-9)
        assert r.accel == pytest.approx((apart**3).sum() / (6 * (apart**2).sum() ** 1.5 + 1e-60), rel=1e-5, abs=1e-7)


def test_folds_are_taken_out_of_the_whole(frame, held):
    rows = statistics.cross_validated(frame, OWN, "r", ["symbol"], "i", 4).collect()
    assert len(rows) == 3 * 4 * 4
    for r in rows:
        parts = np.array_split(held[r.symbol], 4)
        rest = np.concatenate([p for k, p in enumerate(parts) if k != r.fold])
        assert r.inside == pytest.approx(PLAIN[r.statistic](parts[r.fold]), rel=1e-7, abs=1e-9)
        assert r.outside == pytest.approx(PLAIN[r.statistic](rest), rel=1e-7, abs=1e-9)


def test_bounds_hold_the_estimate(frame):
    rows = statistics.bca(frame, OWN, "r", ["symbol"], "i", 200, 5, (0.05,)).collect()
    assert len(rows) == 12 and all(r.low <= r.high for r in rows)
    theta = {(r.symbol, r.statistic): r.theta for r in statistics.jackknife(frame, OWN, "r", ["symbol"], "i").collect()}
    assert sum(r.low <= theta[r.symbol, r.statistic] <= r.high for r in rows) >= 11
    assert statistics.bca(frame.limit(0), OWN, "r", ["symbol"], "i", 5, 5).count() == 0


@pytest.mark.parametrize("v", [1, 2, 3, 5, 40])
def test_gammas_of_half_shapes_have_their_moments(spark, v):
    n = 20_000
    row = spark.range(n).select(rng.gamma_half(4, v, "id").alias("g")).agg(F.avg("g").alias("m"), F.var_pop("g").alias("s"), F.min("g").alias("low")).first()
    shape = v / 2
    assert row.low > 0 and row.m == pytest.approx(shape, abs=5 * math.sqrt(shape / n)) and row.s == pytest.approx(shape, rel=0.12)


def test_rows_without_an_accepted_candidate_are_drawn_otherwise(spark, monkeypatch):
    monkeypatch.setattr(rng, "TRIES", 1)
    n = 20_000
    row = spark.range(n).select(rng.gamma_half(4, 7, "id").alias("g")).agg(F.avg("g").alias("m"), F.var_pop("g").alias("s"), F.count("g").alias("n")).first()
    assert row.n == n and row.m == pytest.approx(3.5, abs=0.07) and row.s == pytest.approx(3.5, rel=0.1)


def test_betas_of_half_parameters_have_their_moments(spark):
    row = spark.range(20_000).select(rng.beta_half(8, 3, 5, "id").alias("b")).agg(F.avg("b").alias("m"), F.var_pop("b").alias("s"), F.min("b").alias("low"), F.max("b").alias("high")).first()
    assert 0 < row.low and row.high < 1 and row.m == pytest.approx(3 / 8, abs=0.01) and row.s == pytest.approx(15 / (64 * 5), rel=0.1)


def test_keys_may_be_any_columns(spark):
    gen = random.Random(1)
    rows = [("x", k % 2, k, gen.random()) for k in range(20)]
    df = spark.createDataFrame(rows, "a string, b int, i int, r double")
    found = statistics.bootstrap(df, {"mean": statistics.MEAN}, "r", ["a", "b"], "i", 3, 1)
    assert found.columns == ["a", "b", "statistic", "rep", "stat"] and found.count() == 6


def test_no_candidate_is_drawn_after_the_first_accepted(spark, monkeypatch):
    drawn = rng.uniform
    last = lambda k: F.when(k < rng.TRIES - 1, F.lit(0.0)).otherwise(F.raise_error(F.lit("drawn in vain")).cast("double"))
    monkeypatch.setattr(rng, "uniform", lambda seed, *parts: drawn(seed, *parts) + last(parts[-1]) if len(parts) > 1 else drawn(seed, *parts))
    assert spark.range(20).select(rng.beta_half(13, 3, 5, "id").alias("b")).where("b > 0").count() == 20
