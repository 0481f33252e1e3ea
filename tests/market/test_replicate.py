import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from barloom.functions import rng
from barloom.operators import replicate, resample

changes = st.lists(st.floats(-5, 5), min_size=1, max_size=12)


def plain_fall(values):
    upto = np.cumsum(values)
    return max(max(upto[: k + 1]) - upto[k] for k in range(len(upto)))


@settings(max_examples=60, deadline=None)
@given(changes, changes, changes)
def test_falls_join_in_any_grouping(a, b, c):
    x, y, z = (replicate.fall_of(np.array(v)[:, None]) for v in (a, b, c))
    for found in (x.then(y).then(z), x.then(y.then(z)), replicate.NOTHING.then(x).then(y.then(z)), x.then(y).then(z.then(replicate.NOTHING))):
        assert found.worst[0] == pytest.approx(plain_fall(a + b + c), abs=1e-9)
        assert found.total[0] == pytest.approx(sum(a + b + c), abs=1e-9)
        assert found.high[0] == pytest.approx(max(np.cumsum(a + b + c)), abs=1e-9)


def test_draws_are_those_of_the_column(spark):
    rows = spark.range(40).select(rng.bits(7, F.lit("AB"), F.lit(3), "id").alias("b"), "id").orderBy("id").collect()
    assert replicate.bits(7, ["AB", 3], 40).tolist() == [r.b for r in rows]


def test_paths_stream_whatever_is_held_at_once():
    values = np.random.default_rng(1).normal(size=30)
    whole = replicate.worst_falls(values, 5, [2], 50, 33, True)
    assert np.allclose(whole, replicate.worst_falls(values, 5, [2], 50, 33, True, at_once=7))
    want = [plain_fall(values[replicate.bits(5, [2, b], 33) % 30]) for b in range(50)]
    assert np.allclose(whole, want)
    fast = replicate.worst_falls(values, 5, [2], 4000, 100, False)
    slow = replicate.worst_falls(values, 5, [2], 1000, 100, True)
    assert abs(np.median(fast) - np.median(slow)) < 0.06 * np.median(slow)
    assert np.array_equal(fast, replicate.worst_falls(values, 5, [2], 4000, 100, False))


def plain_totals(x, most):
    out = []
    for lo in range(2, most + 1):
        for s in range(1, lo):
            total = net = 0
            for i in range(most - 1, len(x) - 1):
                side = np.sign(round(np.mean(x[i + 1 - s : i + 1]) - np.mean(x[i + 1 - lo : i + 1]), 12))
                total, net = total + side * (x[i + 1] - x[i]), net + side
            out.append((total, net))
    return out


@pytest.mark.parametrize("bars", [5, 2048])
def test_totals_of_all_pairs_in_blocks(monkeypatch, bars):
    monkeypatch.setattr(replicate, "BARS", bars)
    x = np.cumsum(np.random.default_rng(2).normal(size=80)) + 100
    total, net = replicate.crossover_totals(x, 6)
    want = plain_totals(x, 6)
    assert np.allclose(total, [t for t, _ in want]) and net.tolist() == [int(n) for _, n in want]


def test_permutation_test_equals_a_plain_loop(spark):
    gen = random.Random(3)
    held = {"A": np.cumsum([gen.gauss(0, 1) for _ in range(70)]), "B": np.cumsum([gen.gauss(0.2, 1) for _ in range(45)]), "short": np.array([1.0, 2.0])}
    df = spark.createDataFrame([(k, i, float(v)) for k, x in held.items() for i, v in enumerate(x)], "symbol string, i int, x double")
    most, reps = 5, 37
    got = {r.symbol: r for r in resample.mcpt_trend(df.repartition(3), most, reps, 11).collect()}
    assert set(got) == {"A", "B"}
    for symbol in got:
        x, found = held[symbol], []
        for rep in range(reps):
            y = replicate.shuffled(x, most - 1, replicate.bits(11, [symbol, rep], len(x))[most:] if rep else None)
            total, net = max(plain_totals(y, most), key=lambda t: t[0])
            found.append((total, net * (x[-1] - x[most - 1]) / (len(x) - most)))
        assert got[symbol].original == pytest.approx(found[0][0])
        assert got[symbol].p_value == pytest.approx(np.mean([v >= found[0][0] - 1e-12 for v, _ in found]))
        assert got[symbol].training_bias == pytest.approx(np.mean([v - t for v, t in found[1:]]))


def test_only_rows_of_replications_are_shuffled_after_the_series(spark):
    df = spark.range(3000).select(F.lit("S").alias("symbol"), F.col("id").cast("int").alias("i"), F.sin("id").alias("x"))
    found = replicate.best_crossovers(df, ["symbol"], "x", "i", 20, 64, 1)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Window" not in plan and "Join" not in plan
    assert found.count() == 64


def test_nested_bounds_are_those_of_a_plain_loop(spark):
    values = np.random.default_rng(4).normal(0, 0.02, 50)
    df = spark.createDataFrame([(k, float(v)) for k, v in enumerate(values)], "i int, ret double").repartition(4)
    got = {(r.rep, r.prob): r.drawdown for r in replicate.nested_drawdowns(df, "ret", "i", 5, 30, 20, 9, (0.9, 0.5)).collect()}
    for rep in range(5):
        sample = values[replicate.bits(9, [rep], 50) % 50]
        falls = sorted((1 - math.exp(-plain_fall(sample[replicate.bits(10, [rep, b], 20) % 50]))) * 100 for b in range(30))
        for p in (0.9, 0.5):
            assert got[rep, p] == pytest.approx(falls[math.floor(p * 31) - 1])
