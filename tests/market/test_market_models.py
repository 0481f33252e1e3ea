import json

import numpy as np
import pytest
from pyspark.sql import functions as F

import barloom.plans.catalog as catalog
from barloom.operators import market_models, models, recurrences
from barloom.plans import tools
from barloom.sources import tables


def test_states_add_up_in_any_grouping():
    rows = np.random.default_rng(1).normal(1e6, 1, (40, 3))
    of = market_models.State.of
    whole = of(rows)
    for found in (of(rows[:7]) + of(rows[7:30]) + of(rows[30:]), of(rows[:7]) + (of(rows[7:30]) + of(rows[30:]))):
        assert found.n == 40 and np.allclose(found.mean, whole.mean, rtol=1e-14) and np.allclose(found.products, whole.products, rtol=1e-9)


def test_every_market_as_if_alone(spark, sf_dir):
    bars = tables.bars(spark, sf_dir)
    df, names = tools.features_of(bars)
    found, scored = tools.market_nets(df, names, n_test=60)
    plan = market_models.states(df, names, "target")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(symbol") <= plan.count("Exchange")  # features by market, then states alone
    got = {r.symbol: r for r in found.collect()}
    assert len(got) == 5
    preds = {(r.symbol, r.i): r.pred for r in scored.collect()}
    for symbol in sorted(got)[:2]:
        model, alone, same_names = tools.elastic_net(bars, symbol, n_test=60)
        assert same_names == names
        assert np.allclose(got[symbol].beta, model.beta, atol=1e-6) and got[symbol].lam == pytest.approx(model.lam, rel=1e-6)
        assert got[symbol].explained == pytest.approx(model.explained, abs=1e-8)
        for r in alone.where("pred IS NOT NULL").collect():
            assert preds[symbol, r.i] == pytest.approx(r.pred, abs=1e-7)


def training(spark, sf_dir):
    df, names = tools.features_of(tables.bars(spark, sf_dir))
    return df.dropna(), names


def columns(rows, names):
    x = np.array([[r[n] for n in names] for r in rows])
    y = np.array([r.target for r in rows])
    return (x - x.mean(axis=0)) / x.std(axis=0), (y - y.mean()) / y.std(), x


def test_no_penalty_solves_the_normal_equations(spark, sf_dir):
    df, names = training(spark, sf_dir)
    names = names[:6:2]
    got = {r.symbol: r for r in market_models.fitted(df, names, "target", alpha=0.0, eps=1e-13, most=100_000).collect()}
    for symbol in got:
        x, y, raw = columns(df.where(F.col("symbol") == symbol).collect(), names)
        want = np.linalg.lstsq(x, y, rcond=None)[0]
        assert np.allclose(got[symbol].beta, want, atol=1e-5)
        assert np.allclose(got[symbol].xmeans, raw.mean(axis=0)) and np.allclose(got[symbol].xscales, raw.std(axis=0))


def test_paths_meet_the_conditions_of_their_optimum(spark, sf_dir):
    df, names = training(spark, sf_dir)
    names = names[:8]
    alpha = 0.5
    rows = market_models.paths(df, names, "target", alpha, steps=6, eps=1e-12, most=100_000).collect()
    assert len(rows) == 30
    held = {s: columns(df.where(F.col("symbol") == s).collect(), names) for s in {r.symbol for r in rows}}
    for r in rows:
        x, y, _ = held[r.symbol]
        beta = np.array(r.beta)
        gradient = x.T @ (y - x @ beta) / len(y) - r.lam * (1 - alpha) * beta
        on = beta != 0
        assert np.allclose(gradient[on], r.lam * alpha * np.sign(beta[on]), atol=1e-6)
        assert (np.abs(gradient[~on]) <= r.lam * alpha + 1e-6).all()


def test_many_markets_cost_one_job_of_states(spark):
    gen = np.random.default_rng(2)
    rows = [(f"m{m:03}", i, float(a), float(b), float(2 * a - b + 0.01 * e)) for m in range(120) for i, (a, b, e) in enumerate(gen.normal(size=(30, 3)))]
    df = spark.createDataFrame(rows, "symbol string, i int, a double, b double, target double")
    found = market_models.fitted(df, ["a", "b"], "target", 0.5, block=(F.col("i") / 10).cast("int"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    got = found.collect()
    assert len(got) == 120 and all(r.explained > 0.99 for r in got)
    assert plan.count("Exchange") == 1
    alone = models.fit(df.where("symbol = 'm007'").withColumn("f", (F.col("i") / 10).cast("int")), ["a", "b"], "target", 0.5, "f")
    assert np.allclose(next(r.beta for r in got if r.symbol == "m007"), alone.beta, atol=1e-6)
    assert market_models.fitted(df.limit(0), ["a", "b"], "target").count() == 0


def test_saved_models_of_all_markets_predict_the_same(spark, sf_dir):
    bars = tables.bars(spark, sf_dir).where("symbol < '3'")
    kw = dict(n_test=40, types=("ma", "roc"), increment=4, n_long=2, n_short=1)
    rows = tools.combined_models(bars, **kw).collect()
    assert len({r.symbol for r in rows}) == 2
    for symbol in {r.symbol for r in rows}:
        own = [r for r in rows if r.symbol == symbol]
        saved, scored = tools.combined_model(bars, symbol, **kw)
        want = {r.i: r.pred for r in scored.dropna().collect()}
        assert {r.i for r in own} == set(want) and all(r.pred == pytest.approx(want[r.i], abs=1e-7) for r in own)
        assert json.loads(own[0].model)["specs"] == json.loads(saved)["specs"]
        again = {r.i: r.pred for r in tools.model_predictions(bars.where(F.col("symbol") == symbol), own[0].model).collect()}
        assert all(again[r.i] == pytest.approx(r.pred, abs=1e-9) for r in own)


def test_queries_name_every_feature(spark, sf_dir):
    found = catalog.QUERIES["lambda_path"](spark, sf_dir)
    assert found.columns == ["lam", "f2_6", "f4_6", "f4_12", "f8_12", "symbol"] and found.count() == 100


def test_penalties_of_every_market_and_smoothed_rsi_as_features(spark, sf_dir):
    bars = tables.bars(spark, sf_dir)
    df, names = tools.features_of(bars, n_long=2, n_short=1, rsi_periods=(5, 9))
    assert names[-2:] == ["rsi5", "rsi9"]
    one = df.where("symbol = '1-URGENT'").orderBy("i").collect()
    x = np.array([r.x for r in one])
    want = recurrences.rsi_ema_values(x, 9, 9)
    assert all((r.rsi9 is None) == (r.i < 9) and (r.i < 9 or r.rsi9 == pytest.approx(want[r.i])) for r in one)
    rows = tools.penalty_table(df, names, n_test=60, n_folds=5, steps=8).collect()
    assert len(rows) == 40 and sum(r.chosen for r in rows) == 5
    held = tools.split_folds(df.where("symbol = '1-URGENT'"), 60, 5).where("NOT test")
    best, lams, explained = models.cross_validate(models.gather(held.select("block", *names, "target"), names, "target", "block"), 0.5, 8, 1e-7, 1000)
    own = sorted((r for r in rows if r.symbol == "1-URGENT"), key=lambda r: -r.lam)
    assert np.allclose([r.lam for r in own], lams, rtol=1e-6) and np.allclose([r.explained for r in own], explained, atol=1e-6)
    assert next(r.lam for r in own if r.chosen) == pytest.approx(best)
