"""Small vectors with known results."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.functions import dist
from barloom.operators import backtest, grids, indicators as ind, models, optimize, recurrences as rec, resample, stats


def series(spark, values, **more):
    columns = ["symbol", "i", "x", *more]
    rows = [("a", k, float(v), *[float(c[k]) for c in more.values()]) for k, v in enumerate(values)]
    return spark.createDataFrame(rows, "symbol string, i int, " + ", ".join(f"{c} double" for c in columns[2:]))


def column(df, c):
    return [r[0] for r in df.orderBy("i").select(c).collect()]


def test_sma(spark):
    df = series(spark, [1, 2, 3, 4, 5])
    assert column(df.withColumn("v", ind.sma("x", 3)), "v") == [None, None, 2, 3, 4]
    assert column(series(spark, [1, 2]).withColumn("v", ind.sma("x", 3)), "v") == [None, None]
    assert column(series(spark, [1, 2]).withColumn("v", ind.sma("x", 0)), "v") == [None, None]


def test_recurrences(spark):
    assert column(rec.ema(series(spark, range(1, 11)), 3), "ema") == pytest.approx([None, None, 2, 3, 4, 5, 6, 7, 8, 9])
    line = rec.macd(series(spark, range(1, 31)), 3, 5, 3).orderBy("i").collect()
    assert [r.i for r in line if r.macd is not None][0] == 4 and [r.i for r in line if r.signal is not None][0] == 6
    assert column(rec.rsi_wilder(series(spark, range(20)), 14), "rsi")[14] == 100
    assert column(rec.rsi_wilder(series(spark, range(20, 0, -1)), 14), "rsi")[14] == 0
    assert rec.ema_values(np.array([1.0]), 3).tolist() != [1.0]
    flat = ind.with_changes(series(spark, [1.0] * 30), "x").withColumn("v", ind.rsi_simple(14))
    assert set(column(flat, "v")) == {0.0}


def test_bands_and_oscillators(spark):
    lo, mid, hi = ind.bollinger("x", 5, 2.0)
    last = series(spark, [10, 12, 14, 16, 18]).withColumn("lo", lo).withColumn("mid", mid).withColumn("hi", hi).orderBy("i").collect()[-1]
    assert (last.lo, last.mid, last.hi) == pytest.approx((14 - 2 * math.sqrt(8), 14, 14 + 2 * math.sqrt(8)))
    df = series(spark, [10, 11, 12, 13, 14], h=[10, 11, 12, 13, 14], l=[9, 10, 11, 12, 13])
    assert column(df.withColumn("v", ind.cci("x", "x", "x", 5)), "v")[4] == pytest.approx(111.111111)
    assert column(series(spark, [3] * 5).withColumn("v", ind.cci("x", "x", "x", 5)), "v")[4] == 0
    out = ind.stochastic(df, "h", "l", "x", 3, 2)
    assert column(out, "stoch_k") == [None, None, 100, 100, 100] and column(out, "stoch_d") == [None, None, None, 100, 100]
    assert column(ind.obv(series(spark, [10, 12, 11, 11, 13], v=[100, 200, 150, 50, 300]), "x", "v"), "obv") == [0, 200, 50, 50, 350]


def test_targets_and_returns(spark):
    assert column(series(spark, [1.0, 1.1, 1.05, 1.15]).withColumn("t", ind.targets("x")), "t")[:3] == pytest.approx([0.1, -0.05, 0.1])
    simple = series(spark, [100, 110, 105, 115.5]).withColumn("r", ind.roc("x", 1))
    assert column(simple, "r")[1:] == pytest.approx([0.1, -0.0454545, 0.1], abs=1e-6)


def test_specs(spark):
    rows = ind.spec_grid(spark, ["Ma", "Rsi"], 10, 3, 2).orderBy("k").collect()
    assert len(rows) == 12 and (rows[0].type, rows[0].long_lookback, rows[6].type, rows[6].long_lookback) == ("Ma", 10, "Rsi", 10)


def test_distributions(spark):
    row = spark.range(1).selectExpr(f"{dist.normal_cdf_sql('0.0E0')} AS c", f"{dist.normal_cdf_sql(dist.inverse_normal_sql('0.975E0'))} AS b", f"{dist.log_gamma_sql('0.0E0')} AS g").first()
    assert row.c == pytest.approx(0.5, abs=1e-7) and row.b == pytest.approx(0.975, abs=1e-4) and row.g == 0
    assert [r[0] for r in spark.range(1).select(dist.combinations(F.lit(5.0), F.lit(2))).collect()] == [10]
    assert dist.ibeta(2.0, 3.0, 0.5) == pytest.approx(0.6875) and dist.igamma(1.0, 2.0) == pytest.approx(1 - math.exp(-2))
    assert dist.t_cdf_values(10, 2.228) == pytest.approx(0.975, abs=1e-4) and dist.inverse_t_values(10, 0.975) == pytest.approx(2.228, abs=1e-3)
    assert dist.f_cdf_values(3, 20, 3.0984) == pytest.approx(0.95, abs=1e-4)
    assert dist.order_tail_values(1000, 0.09, 100) == pytest.approx(0.1472, abs=1e-4)
    assert 1 - dist.order_tail_values(1000, 0.11, 100) == pytest.approx(0.1438, abs=1e-4)
    assert dist.quantile_confidence_values(1000, 100, 0.01) == pytest.approx(0.0791, abs=1e-4)
    assert dist.quantile_confidence_values(1000, 100, 0.99) == pytest.approx(0.1231, abs=1e-4)
    assert dist.binomial_tail_values(4, 0.5, 1) == pytest.approx(5 / 16)


def test_quantiles_and_drawdown(spark):
    ten = series(spark, range(1, 11))
    assert tuple(ten.agg(stats.order_quantile("x", 0.5), stats.order_quantile("x", 0.9)).first()) == (5, 9)
    assert series(spark, range(1, 6)).agg(stats.order_quantile("x", 0.5)).first()[0] == 3
    assert stats.drawdown(series(spark, [1, 2, -1, -1]), "x", "i").first().max_drawdown == 2
    assert stats.drawdown(series(spark, [1, 2, 3, 4, 5]), "x", "i").first().max_drawdown == 0
    assert series(spark, [1, -1, 2, -2]).agg(*stats.criteria("x")).first().win_loss == pytest.approx(1)
    fit = stats.regression(spark.createDataFrame([(1.0, 2.0), (2.0, 4.0), (3.0, 6.0)], "a double, b double"), "a", "b").first()
    assert (fit.beta, fit.constant) == pytest.approx((2, 0), abs=1e-9)


def test_returns_matrix_shape(spark):
    rows = grids.crossover_returns(series(spark, range(10)), "x", 5)
    assert rows.select("short", "long").distinct().count() == 10 and rows.select("i").distinct().count() == 5


def simulate(x, signal, cost, budget):
    """Bar by bar."""
    pos, entry, start, trades, path, returns = 0, 0.0, budget, 0, [], []
    c = cost / 100
    for v, s in zip(x, signal, strict=True):
        p = math.exp(v)
        gain = 0 if pos == 0 else (p / entry if pos == 1 else entry / p) - 1
        path.append(budget * (1 + gain) if s == 0 and pos else budget)
        if s and s != pos:
            if pos:
                budget *= 1 + gain - c
                trades += 1
            budget *= 1 - c
            trades += 1
            pos, entry = s, p
    if pos:
        gain = (math.exp(x[-1]) / entry if pos == 1 else entry / math.exp(x[-1])) - 1
        budget *= 1 + gain - c
        trades += 1
    peak, dd = start, 0.0
    for v in path:
        peak = max(peak, v)
        dd = max(dd, (peak - v) / peak)
    return budget, trades, path, 100 * dd


def test_backtest(spark):
    df = series(spark, [math.log(v) for v in (100, 105, 110)], signal=[1, 0, -1]).withColumn("signal", F.col("signal").cast("int"))
    out = backtest.summary(df, 1000.0, 0.0).first()
    assert out.final_budget == pytest.approx(1100) and out.num_trades == 4 and out.num_wins == 1
    rng = np.random.default_rng(5)
    for n in (1, 2, 30, 80):
        x, s = np.cumsum(rng.normal(size=n) * 0.02), rng.integers(-1, 2, n)
        df = series(spark, x, signal=s).withColumn("signal", F.col("signal").cast("int"))
        got, want = backtest.summary(df, 1000.0, 0.1).first(), simulate(x, s, 0.1, 1000.0)
        assert (got.final_budget, got.num_trades, got.max_drawdown) == pytest.approx((want[0], want[1], want[3]))
        assert column(backtest.equity(df, 1000.0, 0.1), "equity") == pytest.approx(want[2])


def test_stochastic_bias(spark):
    rows = [("a", i, s, 9, float(r)) for s, rs in enumerate([(1, 2, 3), (2, 2, 3)]) for i, r in enumerate(rs)]
    out = resample.stochastic_bias(spark.createDataFrame(rows, "symbol string, i int, short int, long int, ret double"), ["symbol"]).first()
    assert (out.is_sum, out.oos_sum) == ((5 + 5 + 4) / 2, 1 + 2 + 3)


def test_permutation_keeps_ends_and_changes(spark):
    df = series(spark, np.cumsum(np.random.default_rng(1).normal(size=40)))
    out = resample.permuted(df, 3, 7, 5).orderBy("rep", "i").collect()
    reps = [[r.x for r in out if r.rep == k] for k in range(3)]
    assert reps[0] == pytest.approx([r.x for r in df.orderBy("i").collect()])
    assert reps[1] != pytest.approx(reps[2]) and all(r[:6] == pytest.approx(reps[0][:6]) and r[-1] == pytest.approx(reps[0][-1]) for r in reps)
    assert sorted(np.diff(reps[1])) == pytest.approx(sorted(np.diff(reps[0])))


def test_blocks(spark):
    for n, want in ((10, [0, 0, 1, 1, 2, 2, 2, 3, 3, 3]), (8, [0, 0, 1, 1, 2, 2, 3, 3]), (3, [1, 2, 3])):
        df = spark.range(n).select(resample.block_of(F.col("id"), F.lit(n), 4).alias("b"))
        assert [r.b for r in df.collect()] == want


def test_elastic_net(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 4))
    y = 2 * x[:, 0] - x[:, 2] + 0.1 * rng.normal(size=300)
    df = spark.createDataFrame([(*map(float, r), float(t), k % 5) for k, (r, t) in enumerate(zip(x, y, strict=True))], "a double, b double, c double, d double, y double, block int")
    model = models.fit(df, ["a", "b", "c", "d"], "y", 0.5, "block")
    assert model.explained > 0.98 and abs(model.beta[0]) > 5 * abs(model.beta[1])
    assert models.Model.from_json(model.to_json()) == model
    scored = df.withColumn("p", backtest.predicted(F.array("a", "b", "c", "d"), vars(model)))
    assert scored.agg(F.corr("p", "y")).first()[0] > 0.99
    plain = models.fit(df, ["a", "b", "c", "d"], "y", 0.0)
    want = np.linalg.lstsq(np.column_stack([np.ones(300), x]), y, rcond=None)[0][1:]
    assert plain.lam == 0 and np.array(plain.beta) * plain.yscale / np.array(plain.xscales) == pytest.approx(want, abs=1e-5)
    with pytest.raises(ValueError):
        models.fit(df, ["a"], "y", 1.5)


def test_optimizers():
    (a, _), (b, _), (c, _) = optimize.global_max(lambda x: -((x - 2) ** 2) + 5, 0.1, 1.0)
    assert optimize.brent_max(lambda x: -((x - 2) ** 2) + 5, a, b, c) == pytest.approx((2, 5), abs=1e-5)
    assert optimize.brent_max(lambda x: -(x**3) + 3 * x * x, 1.0, 1.7, 3.0) == pytest.approx((2, 4), abs=1e-5)
    bounds = optimize.Bounds((-3.0, -3.0), (3.0, 3.0))
    best, value, seen = optimize.differential_evolution(optimize.rosenbrock, bounds, 30, 150, seed=2)
    assert value > 999.9 and best == pytest.approx([1, 1], abs=0.1)
    found = optimize.parameter_correlation(np.concatenate([p for p, _ in seen]), np.concatenate([v for _, v in seen]))
    assert found["correlation"][0, 0] == pytest.approx(1)
    assert optimize.solve(np.array([[2.0, 3.0], [4.0, 1.0]]), np.array([8.0, 10.0])) == pytest.approx([2.2, 1.2])
    legal, penalty = optimize.legalize(np.array([[2.5, 9.0]]), optimize.Bounds((0.0, 0.0), (5.0, 5.0), 1))
    assert legal.tolist() == [[3.0, 5.0]] and penalty[0] == 4e10


def test_weights_and_far_means(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(200, 3)) + 1e6
    y = (x - 1e6) @ [1.0, 0.0, -2.0] + 1e7 + 0.1 * rng.normal(size=200)
    w = rng.integers(1, 4, size=200)
    rows = [(*map(float, r), float(t), float(v)) for r, t, v in zip(x, y, w, strict=True)]
    df = spark.createDataFrame(rows, "a double, b double, c double, y double, w double")
    m = models.gather(df, ["a", "b", "c"], "y", weight="w")[0]
    gram, xy, means, scales, ymean, yscale = models.standardized(m)
    z, t = (x - x.mean(axis=0)) / x.std(axis=0), (y - y.mean()) / y.std()
    assert gram == pytest.approx((z * w[:, None]).T @ z / w.sum(), abs=1e-6) and xy == pytest.approx((z * w[:, None]).T @ t / w.sum(), abs=1e-6)
    model = models.fit(df, ["a", "b", "c"], "y", 0.0, weight="w")
    assert np.array(model.beta) * model.yscale / np.array(model.xscales) == pytest.approx([1, 0, -2], abs=0.05) and model.xmeans == pytest.approx(x.mean(axis=0).tolist())


def test_trades_are_asked_for_less_after_failures():
    least = [100]

    def evaluate(points):
        return np.where(points[:, 0] * 10 >= least[0], points[:, 0], -1.0)

    relax = lambda: least.__setitem__(0, max(1, least[0] * 9 // 10))
    best, value, _ = optimize.differential_evolution(evaluate, optimize.Bounds((0.0, 0.0), (5.0, 1.0)), 20, 5, seed=1, relax=relax, failures=50)
    assert value > 0 and least[0] < 60
