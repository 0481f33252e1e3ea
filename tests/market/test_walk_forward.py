"""Walk-forward folds against plain loops over each fold's own slice of prices."""

import math
import random

import pytest

from barloom.operators import grids, resample
from barloom.plans import tools

MOST, STEPS, TRAIN, TEST = 5, 3, 40, 15


@pytest.fixture(scope="module")
def prices():
    rng = random.Random(12)
    out = {}
    for name, n in (("a", 131), ("b", 97)):
        x = [1.0]
        for _ in range(n - 1):
            x.append(x[-1] + rng.uniform(-0.05, 0.052))
        out[name] = x
    return out


@pytest.fixture(scope="module")
def bars(spark, prices):
    return spark.createDataFrame([(s, i, v) for s, x in prices.items() for i, v in enumerate(x)], "symbol string, i int, x double")


def positions(x, look, k, first, end, pos=0):
    """(bar, position) of the decisions from ``first`` to before ``end``."""
    out = []
    for i in range(first, end):
        mean = sum(x[i - look + 1 : i + 1]) / look
        pos = 1 if x[i] > (1 + k / 100) * mean else 0 if x[i] < mean else pos
        out.append((i, pos))
    return out


def value(returns, criterion):
    n, total = len(returns), sum(returns)
    mean = total / (n + 1e-30)
    if criterion == "profit_factor":
        return (sum(r for r in returns if r > 0) + 1e-60) / (-sum(r for r in returns if r < 0) + 1e-60)
    return mean if criterion == "mean" else mean / math.sqrt(max(sum(r * r for r in returns) / (n + 1e-30) - mean * mean, 1e-20))


def breakout_loop(x, criterion, all_bars, kind):
    out, start = [], 0
    while start + TRAIN < len(x):
        slice_, best = x[start : start + TRAIN], None
        for look in range(2, MOST + 1):
            for k in range(1, STEPS + 1):
                held = positions(slice_, look, k, MOST - 1, TRAIN - 1)
                v = round(value([(slice_[i + 1] - slice_[i]) * p for i, p in held if all_bars or p], criterion), 10)
                if best is None or v > best[0]:
                    best = v, look, k, held[-1][1]
        _, look, k, last = best
        n = min(TEST, len(x) - start - TRAIN)
        first = start + TRAIN - 1
        held = positions(x, look, k, first, first + n, last)
        if kind < 2:
            out += [(i, x[i + 1] - x[i] if p else 0.0) for i, p in held if p or not kind]
        else:
            opened = None
            for i, p in held:
                if p and opened is None:
                    opened = i
                elif not p and opened is not None:
                    out.append((i - 1, x[i] - x[opened]))
                    opened = None
                elif p and i == first + n - 1:
                    out.append((i, x[i + 1] - x[opened]))
        start += n
    return out


@pytest.mark.parametrize(("criterion", "all_bars", "kind"), [("mean", False, 0), ("mean", True, 1), ("profit_factor", False, 2), ("sharpe", False, 2), ("sharpe", True, 0)])
def test_breakout_folds_are_those_of_the_loop(bars, prices, criterion, all_bars, kind):
    out = tools.walk_forward_breakout(bars, MOST, TRAIN, TEST, kind, criterion, all_bars, STEPS).collect()
    for s, x in prices.items():
        got = sorted((r.i, r.ret) for r in out if r.symbol == s)
        want = sorted(breakout_loop(x, criterion, all_bars, kind))
        assert [i for i, _ in got] == [i for i, _ in want]
        assert [r for _, r in got] == pytest.approx([r for _, r in want], abs=1e-9)


def test_crossover_folds_are_those_of_the_loop(bars, prices):
    got = {(r.symbol, r.fold): r.ret for r in tools.fold_returns(bars, MOST, TRAIN, TEST).collect()}
    want = {}
    for s, x in prices.items():
        start = fold = 0
        while start + TRAIN < len(x):
            part = x[start : start + TRAIN]

            def ret(x, i, short, long):
                a, b = sum(x[i - short + 1 : i + 1]) / short, sum(x[i - long + 1 : i + 1]) / long
                return (x[i + 1] - x[i]) * ((a > b) - (a < b))

            pairs = [(short, long) for long in range(2, MOST) for short in range(1, long)]
            totals = [round(sum(ret(part, i, *p) for i in range(p[1] - 1, TRAIN - 1)) / (TRAIN - p[1]), 10) for p in pairs]
            best = pairs[totals.index(max(totals))]
            n = min(TEST, len(x) - start - TRAIN)
            want[s, fold] = 25200 * sum(ret(x, i, *best) for i in range(start + TRAIN - 1, start + TRAIN - 1 + n)) / n
            start, fold = start + n, fold + 1
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-6) for k in want)


def test_one_sided_criteria_count_only_their_trades(bars, prices):
    x = prices["b"]
    row = grids.crossover_grid(bars.where("symbol = 'b'"), "x", 4, "long").where("short = 1 AND long = 3").first()
    held = [x[i + 1] - x[i] for i in range(3, len(x) - 1) if x[i] > sum(x[i - 2 : i + 1]) / 3]
    assert row.n_long == len(held) and row.mean == pytest.approx(sum(held) / len(held))
    assert row.sharpe == pytest.approx(value(held, "sharpe")) and row.profit_factor == pytest.approx(value(held, "profit_factor"))


def test_segments_are_shuffled_apart(spark):
    df = spark.createDataFrame([(s, i, float(i * i + (s == "b"))) for s in "ab" for i in range(30)], "symbol string, i int, x double")
    out = {}
    for r in resample.permuted(df, 3, 5, 0, joint=True, cuts=(10, 20)).collect():
        out.setdefault((r.symbol, r.rep), {})[r.i] = r.x
    for (s, _), x in out.items():
        steps = [x[i] - x[i - 1] for i in range(1, 30)]
        for a, b in ((0, 9), (9, 19), (19, 29)):
            assert sorted(steps[a:b]) == pytest.approx([2.0 * i + 1 for i in range(a, b)])
        assert [round(v - (s == "b"), 6) for v in x.values()] == [round(v, 6) for v in out["a", _].values()]
    assert out["a", 0] != out["a", 1]
