import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.operators import ordered, recurrences, stats


def at(values, p):
    held = sorted(values)
    return held[min(max(math.floor(p * (len(held) + 1)) - 1, 0), len(held) - 1)]


PROBS = (0.0, 0.001, 0.1, 0.5, 0.77, 0.999, 1.0)


def shapes():
    rng = random.Random(2)
    yield "ties", [float(rng.randrange(7)) for _ in range(3000)]
    yield "skewed", [math.exp(rng.gauss(0, 30)) for _ in range(3000)]
    yield "nearly one value", [5.0] * 2900 + [rng.random() * 10 for _ in range(100)]
    yield "few", [2.0, 1.0]
    yield "negative zero", [-0.0, 0.0, -1.0] * 50


@pytest.mark.parametrize("most, splitters", [(20, 4), (200, 16)])
def test_quantiles_equal_those_of_sorted_values(spark, most, splitters):
    rows = [(name, v) for name, held in shapes() for v in held] + [("empty", None), (None, 3.0), (None, 4.0), (None, None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    got = {(r.g, r.prob): (r.n, r.quantile) for r in ordered.quantiles(df, "v", PROBS, ["g"], most, splitters).collect()}
    held = dict(shapes()) | {None: [3.0, 4.0]}
    assert got == {(g, p): (len(v), at(v, p)) for g, v in held.items() for p in PROBS}


def test_quantiles_of_one_group_without_a_key(spark):
    values = dict(shapes())["skewed"]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = {r.prob: r.quantile for r in ordered.quantiles(df, "v", PROBS, most=50, splitters=8).collect()}
    assert got == {p: at(values, p) for p in PROBS}
    assert ordered.quantiles(df.limit(0), "v", PROBS).count() == 0


def test_running_sums_over_blocks_and_keys(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "a", "a", "b", None]), k, rng.randrange(-5, 9)) for k in range(700)]
    df = spark.createDataFrame(rows, "k string, t int, v long")
    for by in ([], ["k"]):
        held = ordered.placed(df.repartition(3), [*by, "t"], rows=10)
        assert held.groupBy("_block").count().where("count > 10").count() == 0 and held.select("_block").distinct().count() >= 70
        got = {(r.k, r.t): (r.before, r.i, r.old) for r in ordered.running(held, {"before": "v", "i": F.lit(1)}, by, {"old": "v"}).collect()}
        want, now = {}, {}
        for k, t, v in rows:
            of = k if by else "all"
            total, n, last = now.get(of, (0, 0, None))
            want[k, t] = (total, n, last)
            now[of] = (total + v, n + 1, v)
        assert got == want


def test_no_task_of_an_unkeyed_order_holds_much_more_than_another(spark):
    df = spark.range(200_000).select((F.rand(1) * 1000).alias("v"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # as where there is more than fits one task
    try:
        held = ordered.placed(df, ["v"], rows=1000)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sizes = sorted(r["count"] for r in held.groupBy(F.shiftright("_at", 33)).count().collect())
    assert len(sizes) >= 4 and sizes[-1] < 2 * sizes[len(sizes) // 2]
    plan = stats.ks_uniform(df.select((F.col("v") / 1000).alias("v")), "v")._jdf.queryExecution().executedPlan().toString()
    # rows meet in blocks; only the blocks' totals, one row each, are added up in one place
    windows = [line for line in plan.split("\n") if "Window" in line]
    assert all("_block" in line for line in windows)


def test_tests_of_rank_without_a_key_equal_plain_ones(spark):
    rng = random.Random(8)
    rows = [(round(rng.random(), 2), rng.random() < 0.4, k, rng.choice([-1.0, 0.0, 2.0])) for k in range(900)]
    df = spark.createDataFrame(rows, "v double, f boolean, t int, g double").repartition(4)
    values = sorted(r[0] for r in rows)
    n = len(values)
    got = stats.ks_uniform(df, "v").first()
    assert got.d_plus == pytest.approx(max((k + 1) / n - v for k, v in enumerate(values)), abs=1e-12)
    assert got.d_minus == pytest.approx(max(v - k / n for k, v in enumerate(values)), abs=1e-12)
    floor = lambda x: math.log(max(x, 1e-30))
    s = sum((2 * k + 1) * floor(v) + (2 * (n - k) - 1) * floor(1 - v) for k, v in enumerate(values))
    assert stats.anderson_darling(df, "v").first().a2 == pytest.approx(-n - s / n, rel=1e-9)
    first, rest = [r[0] for r in rows if r[1]], [r[0] for r in rows if not r[1]]
    u = sum((b > a) + 0.5 * (a == b) for a in first for b in rest)
    assert stats.mann_whitney(df, "v", F.col("f")).first().u == pytest.approx(u, abs=1e-6)
    won, area, wins, losses = 0.0, 0.0, 0.0, 0.0
    for v, _, t, g in sorted(rows, key=lambda r: (-r[0], r[2])):
        won += max(g, 0)
        area += won * max(-g, 0)
        wins, losses = wins + max(g, 0), losses + max(-g, 0)
    assert stats.roc_area(df, "v", "g", "t").first().roc_area == pytest.approx(area / (wins * losses), abs=1e-9)


@pytest.mark.parametrize("rows", [7, 50, 1 << 16])
def test_recurrences_in_blocks_equal_those_of_one_pass(spark, rows):
    rng = np.random.default_rng(4)
    held = {"long": rng.normal(100, 5, 400), "short": rng.normal(3, 1, 20), "tiny": np.array([1.0, 2.0]), "rising": np.arange(1.0, 60.0)}
    data = [(k, i, float(v)) for k, x in held.items() for i, v in enumerate(x)]
    series = ordered.series(spark.createDataFrame(data, "k string, t int, v double").repartition(3), "v", ["k"], ["t"], rows)
    number = lambda v: float("nan") if v is None else v

    def check(df, columns, plain):
        found = {}
        for r in df.collect():
            found.setdefault(r.k, {})[r.i] = [number(r[c]) for c in columns]
        for k, x in held.items():
            np.testing.assert_allclose(np.array([found[k][i] for i in range(len(x))]), np.stack(plain(x), axis=1), rtol=1e-9, atol=1e-9)

    check(ordered.ema(series, 10, ["k"]), ["ema"], lambda x: [recurrences.ema_values(x, 10)])
    check(ordered.rsi_wilder(series, 14, ["k"]), ["rsi"], lambda x: [recurrences.rsi_wilder_values(x, 14)])
    check(ordered.macd(series, 5, 12, 4, ["k"]), ["macd", "signal", "histogram"], lambda x: list(recurrences.macd_values(x, 5, 12, 4)))


def test_affine_maps_compose():
    rng = np.random.default_rng(1)
    a, b = rng.choice([0.0, 0.5, 1.0, 0.9], 200), rng.normal(size=200)
    want, now = [], 0.0
    for x, y in zip(a, b, strict=True):
        now = x * now + y
        want.append(now)
    y, factor = ordered.affine_values(a, b)
    np.testing.assert_allclose(y, want, atol=1e-12)
    tail, product = ordered.affine_values(a[80:], b[80:])
    np.testing.assert_allclose(tail + product * want[79], want[80:], atol=1e-12)
