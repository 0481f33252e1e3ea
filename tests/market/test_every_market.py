import pytest

from barloom.operators import optimize
from barloom.plans import catalog
from barloom.sources import tables


@pytest.mark.parametrize("name", ["elastic_net", "elastic_net_out_of_sample", "lambda_path", "differential_evolution"])
def test_no_market_is_left_out(spark, sf_dir, name):
    want = {r.symbol for r in tables.bars(spark, sf_dir).select("symbol").distinct().collect()}
    assert {r.symbol for r in catalog.QUERIES[name](spark, sf_dir).select("symbol").distinct().collect()} == want and len(want) == 5


def test_mean_bounds_of_every_market(spark):
    found = catalog.QUERIES["mean_bounds"](spark, "/root/testdata/sf0.01")
    assert found.select("symbol").distinct().count() == 5


def test_quantiles_have_the_five_levels_of_their_sql(spark, sf_dir):
    assert catalog.QUERIES["order_quantiles"](spark, sf_dir).columns == ["symbol", *[f"q{k}" for k in range(5)], "low", "high", "median"]


def test_searches_in_step_find_what_they_find_alone():
    bounds, calls = optimize.Bounds((-3.0, -3.0), (3.0, 3.0)), []

    def evaluate(asked):
        calls.append(len(asked))
        return {k: optimize.sphere(p) for k, p in asked.items()}

    found = optimize.in_step(evaluate, {k: optimize.evolution(bounds, 10, 5, seed=k) for k in (1, 2, 3)})
    assert len(calls) <= 11 and calls[0] == 3
    for k, (best, value, _) in found.items():
        alone = optimize.differential_evolution(optimize.sphere, bounds, 10, 5, seed=k)
        assert best.tolist() == alone[0].tolist() and value == alone[1]
