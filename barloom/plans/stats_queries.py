"""Distribution functions, tests, contingency, quantiles and criteria."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dist, symbols
from ..operators import indicators as ind, ordered, stats
from ..sources import tables
from . import catalog, tail_sql
from .indicator_queries import O, ema_sql, slope_sql, sql

RETURNS = f"ret AS (SELECT symbol, i, x, lead(x) OVER {O} - x AS r FROM bars), rr AS (SELECT * FROM ret WHERE r IS NOT NULL)"


def returns(spark, sf_dir):
    return tables.bars(spark, sf_dir).withColumn("r", ind.targets("x")).where("r IS NOT NULL").select("symbol", "i", "x", "r")


def lineitem(spark, sf_dir):
    return tables.table(spark, sf_dir, "lineitem")


def register(add) -> None:
    q = catalog.rounded
    points = "(id - 500) / 100.0E0"
    add(
        "normal_functions",
        lambda s, d: s.range(1001).selectExpr(
            "id", f"round({dist.normal_cdf_sql(points)}, 8) AS cdf", f"round({dist.inverse_normal_sql('((id + 1) / 1003.0E0)')}, 8) AS inverse",
            f"round({dist.erfc_sql(points)}, 8) AS erfc", f"round({dist.half_normal_sql(points)}, 8) AS half",
        ),
        f"SELECT id, round({dist.normal_cdf_sql(points)}, 8) AS cdf, round({dist.inverse_normal_sql('((id + 1) / 1003.0E0)')}, 8) AS inverse, "
        f"round({dist.erfc_sql(points)}, 8) AS erfc, round({dist.half_normal_sql(points)}, 8) AS half FROM range(1001) t(id)",
    )
    add(
        "log_gamma",
        lambda s, d: s.range(1, 2001).selectExpr("id", f"round({dist.log_gamma_sql('(id / 10.0E0)')}, 6) AS lg"),
        "SELECT id, round(lgamma(id / 10.0), 6) AS lg FROM range(1, 2001) t(id)",
    )
    add(
        "poisson",
        lambda s, d: s.range(60).selectExpr("id", f"round({dist.poisson_sql('id', '7.5E0')}, 8) AS p"),
        "SELECT id, round(exp(-7.5 + id * ln(7.5) - lgamma(id + 1)), 8) AS p FROM range(60) t(id)",
    )
    add(
        "anderson_darling_cdf",
        lambda s, d: s.range(1, 600).selectExpr("id", f"round({dist.anderson_darling_sql('(id / 100.0E0)')}, 8) AS p"),
        f"SELECT id, round({dist.anderson_darling_sql('(id / 100.0E0)')}, 8) AS p FROM range(1, 600) t(id)",
    )
    add(
        "ks_distribution",
        lambda s, d: s.range(1, 200).select("id", F.round(dist.ks_cdf(F.lit(100.0), F.col("id") / 500.0), 6).alias("cdf"), F.round(dist.ks_inverse(F.lit(100.0), F.col("id") / 200.0), 6).alias("inverse")),
        "WITH t AS (SELECT id, (sqrt(100.0) + 0.12 + 0.11 / sqrt(100.0)) * id / 500.0 AS z FROM range(1, 200) r(id)) "
        "SELECT t.id, round(1.0 - (SELECT sum(CASE WHEN j % 2 = 1 THEN 2.0 ELSE -2.0 END * exp(-2.0 * j * j * t.z * t.z)) FROM range(1, 100) g(j)), 6) AS cdf, "
        "round(sqrt(0.5 * ln(2.0 / (1.0 - t.id / 200.0))) / (sqrt(100.0) + 0.12 + 0.11 / sqrt(100.0)), 6) AS inverse FROM t",
    )
    add(
        "gamma_half_and_combinations",
        lambda s, d: s.range(1, 20).select("id", F.round(dist.gamma_half(F.col("id").cast("int")), 4).alias("gamma_half"), F.round(dist.combinations(F.lit(20.0), F.col("id")), 2).alias("choose")),
        "SELECT id, round(gamma(id / 2.0), 4) AS gamma_half, round(CAST(factorial(20) AS DOUBLE) / (CAST(factorial(CAST(id AS INTEGER)) AS DOUBLE) * CAST(factorial(CAST(20 - id AS INTEGER)) AS DOUBLE)), 2) AS choose FROM range(1, 20) t(id)",
    )
    tails = {
        "t_cdf": (lambda: dist.t_cdf(F.lit(9.0), F.col("id") / 20.0), tail_sql.t_cdf("9.0", "id / 20.0")),
        "inverse_t": (lambda: dist.inverse_t(F.lit(9.0), F.col("id") / 100.0), tail_sql.inverse(lambda x: tail_sql.t_cdf("9.0", x), "id / 100.0", "-1e4", "1e4", 70)),
        "f_cdf": (lambda: dist.f_cdf(F.lit(3.0), F.lit(20.0), F.col("id") / 10.0), tail_sql.f_cdf("3.0", "20.0", "id / 10.0")),
        "igamma": (lambda: dist.incomplete_gamma(F.lit(2.5), F.col("id") / 10.0), tail_sql.igamma("2.5", "id / 10.0")),
        "ibeta": (lambda: dist.incomplete_beta(F.lit(2.0), F.lit(3.5), F.col("id") / 100.0), tail_sql.ibeta("2.0", "3.5", "id / 100.0")),
        "inverse_ibeta": (lambda: dist.inverse_beta(F.col("id") / 100.0, F.lit(2.0), F.lit(3.5)), tail_sql.inverse(lambda x: tail_sql.ibeta("2.0", "3.5", x), "id / 100.0")),
        "binomial": (lambda: dist.binomial_tail(F.lit(100.0), F.lit(0.3), F.col("id").cast("double")), tail_sql.binomial_tail("100.0", "0.3", "CAST(id AS DOUBLE)")),
        "order_tail": (lambda: dist.order_tail(F.lit(1000.0), F.col("id") / 1000.0, F.lit(50.0)), tail_sql.order_tail("1000.0", "id / 1000.0", "50.0")),
        "quantile_conf": (lambda: dist.quantile_confidence(F.lit(1000.0), F.col("id").cast("double"), F.lit(0.95)), tail_sql.quantile_confidence("1000.0", "CAST(id AS DOUBLE)", "0.95")),
        "chi2_tail": (lambda: dist.chi2_tail(F.lit(4.0), F.col("id") / 5.0), tail_sql.chi2_tail("4.0", "id / 5.0")),
    }
    add(
        "distribution_tails",
        lambda s, d: q(s.range(1, 100).select("id", *[c().alias(n) for n, (c, _) in tails.items()])),
        "SELECT id, " + ", ".join(f"round({e}, 6) AS {n}" for n, (_, e) in tails.items()) + " FROM range(1, 100) t(id)",
    )
    add("t_one_sample", lambda s, d: q(stats.t_one(returns(s, d), "r", ["symbol"])), sql("symbol, count(r) AS n, round(avg(r), 6) AS mean, round(avg(r) / (sqrt(var_samp(r) / count(r)) + 1e-60), 6) AS t", RETURNS, "rr", "GROUP BY symbol"))
    pooled = "sqrt((v1 * n1 + v2 * n2) / (n1 + n2 - 2) * (1.0 / n1 + 1.0 / n2))"
    add(
        "t_two_sample",
        lambda s, d: q(stats.t_two(lineitem(s, d), "l_extendedprice", F.col("l_linestatus") == "F", ["l_returnflag"]).select("l_returnflag", "n1", "n2", "t")),
        f"WITH a AS (SELECT l_returnflag, l_linestatus = 'F' AS f, l_extendedprice AS p FROM lineitem), b AS (SELECT l_returnflag, count(*) FILTER (f) AS n1, count(*) FILTER (NOT f) AS n2, avg(p) FILTER (f) AS m1, avg(p) FILTER (NOT f) AS m2, var_pop(p) FILTER (f) AS v1, var_pop(p) FILTER (NOT f) AS v2 FROM a GROUP BY 1) "
        f"SELECT l_returnflag, n1, n2, round(CASE WHEN {pooled} < 1e-10 THEN 0.0 ELSE (m1 - m2) / {pooled} END, 6) AS t FROM b",
    )
    ranks = "SELECT *, rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2.0 AS rk, count(*) OVER (PARTITION BY l_returnflag, l_quantity) AS td FROM lineitem"
    add(
        "mann_whitney",
        lambda s, d: q(stats.mann_whitney(lineitem(s, d), "l_quantity", F.col("l_linestatus") == "F", ["l_returnflag"]), 4),
        f"WITH a AS ({ranks}), b AS (SELECT l_returnflag, CAST(count(*) FILTER (l_linestatus = 'F') AS DOUBLE) AS n1, CAST(count(*) FILTER (l_linestatus <> 'F') AS DOUBLE) AS n2, sum(rk) FILTER (l_linestatus = 'F') AS r1, sum(CAST(td AS DOUBLE) * td - 1) AS ties FROM a GROUP BY 1), "
        "c AS (SELECT *, n1 + n2 AS n, n1 * n2 + n1 * (n1 + 1) / 2 - r1 AS u FROM b) SELECT l_returnflag, round(u, 4) AS u, round((u - n1 * n2 / 2) / sqrt(n1 * n2 / (n * (n - 1)) * ((n * n * n - n) / 12 - ties / 12)), 4) AS z FROM c",
    )
    unit = "u AS (SELECT symbol, i, row_number() OVER (PARTITION BY symbol ORDER BY r, i) AS k, r, (r - min(r) OVER (PARTITION BY symbol) + 1e-4) / (max(r) OVER (PARTITION BY symbol) - min(r) OVER (PARTITION BY symbol) + 2e-4) AS v, count(*) OVER (PARTITION BY symbol) AS n FROM rr)"

    def units(s, d):
        from pyspark.sql.window import Window

        w = Window.partitionBy("symbol")
        return returns(s, d).select("symbol", "i", ((F.col("r") - F.min("r").over(w) + 1e-4) / (F.max("r").over(w) - F.min("r").over(w) + 2e-4)).alias("v"))

    add("ks_uniform", lambda s, d: q(stats.ks_uniform(units(s, d), "v", ["symbol"])), sql("symbol, round(max(k / n - v), 6) AS d_plus, round(max(v - (k - 1) / n), 6) AS d_minus", f"{RETURNS}, {unit}", "u", "GROUP BY symbol"))
    ad = f"{RETURNS}, {unit}, s AS (SELECT symbol, max(n) AS n, sum((2 * k - 1) * ln(greatest(v, 1e-30)) + (2 * (n + 1 - k) - 1) * ln(greatest(1 - v, 1e-30))) AS s FROM u GROUP BY symbol), a AS (SELECT symbol, -n - s / n AS a2 FROM s)"
    add("anderson_darling", lambda s, d: q(stats.anderson_darling(units(s, d), "v", ["symbol"]), 5), sql(f"symbol, round(a2, 5) AS a2, round({dist.anderson_darling_sql('a2')}, 5) AS p", ad, "a"))
    cells = "SELECT c_mktsegment AS g, count(*) AS n, sum(c_acctbal) AS s, avg(c_acctbal) AS m, var_pop(c_acctbal) AS v FROM customer GROUP BY 1"
    add(
        "anova",
        lambda s, d: q(stats.anova(tables.table(s, d, "customer"), "c_acctbal", "c_mktsegment").drop("p"), 6),
        f"WITH c AS ({cells}), t AS (SELECT count(*) AS k, CAST(sum(n) AS BIGINT) AS n, (sum(s * m) - sum(s) * sum(s) / sum(n)) / (count(*) - 1) AS b, sum(v * n) / (sum(n) - count(*)) AS w FROM c) SELECT k, n, round(b / (w + 1e-60), 6) AS f, round(b / (b + w + 1e-60), 6) AS account FROM t",
    )
    add(
        "anova_p",
        lambda s, d: q(stats.anova(tables.table(s, d, "customer"), "c_acctbal", "c_mktsegment").select("p")),
        f"WITH c AS ({cells}), t AS (SELECT CAST(count(*) AS DOUBLE) AS k, CAST(sum(n) AS DOUBLE) AS n, (sum(s * m) - sum(s) * sum(s) / sum(n)) / (count(*) - 1) AS b, sum(v * n) / (sum(n) - count(*)) AS w FROM c), f AS (SELECT k - 1 AS d1, n - k AS d2, b / (w + 1e-60) AS f FROM t) SELECT round({tail_sql.ibeta('0.5 * d2', '0.5 * d1', 'd2 / (d2 + d1 * f)')}, 6) AS p FROM f",
    )
    add(
        "kruskal_wallis",
        lambda s, d: q(stats.kruskal_wallis(lineitem(s, d), "l_quantity", "l_linestatus", ["l_returnflag"]).drop("p"), 5),
        f"WITH a AS ({ranks}), t AS (SELECT l_returnflag, sum(CAST(td AS DOUBLE) * td - 1) AS ties, count(*) AS n FROM a GROUP BY 1), c AS (SELECT l_returnflag, l_linestatus, sum(rk) AS r, count(*) AS c FROM a GROUP BY 1, 2), s AS (SELECT l_returnflag, sum(r * r / c) AS rr, count(*) AS k FROM c GROUP BY 1) "
        "SELECT l_returnflag, k, n, round((rr * 12 / (CAST(n AS DOUBLE) * (n + 1)) - 3 * (n + 1)) / (1 - ties / (CAST(n AS DOUBLE) * n * n - n)), 5) AS h FROM s JOIN t USING (l_returnflag)",
    )
    table = (
        "cells AS (SELECT l_returnflag AS r, l_linestatus AS c, CAST(count(*) AS DOUBLE) AS n FROM lineitem GROUP BY 1, 2), "
        "m AS (SELECT *, sum(n) OVER (PARTITION BY r) AS nr, sum(n) OVER (PARTITION BY c) AS nc, sum(n) OVER () AS t FROM cells)"
    )
    add(
        "chi_square",
        lambda s, d: q(stats.chi_square(lineitem(s, d), "l_returnflag", "l_linestatus").drop("p"), 5),
        f"WITH {table}, s AS (SELECT sum(pow(n - nr * nc / t, 2) / (nr * nc / t)) + max(t) - sum(nr * nc / t) AS chi2, CAST((count(DISTINCT r) - 1) * (count(DISTINCT c) - 1) AS DOUBLE) AS df, max(t) AS t, least(count(DISTINCT r), count(DISTINCT c)) AS k FROM m) "
        "SELECT round(chi2, 5) AS chi2, round(df, 5) AS df, round(sqrt(chi2 / (chi2 + t)), 5) AS contingency, round(sqrt(chi2 / (t * (k - 1))), 5) AS cramer_v FROM s",
    )
    add(
        "chi_square_p",
        lambda s, d: q(stats.chi_square(lineitem(s, d), "l_returnflag", "l_linestatus").select("p")),
        f"WITH {table}, s AS (SELECT sum(pow(n - nr * nc / t, 2) / (nr * nc / t)) + max(t) - sum(nr * nc / t) AS chi2, CAST((count(DISTINCT r) - 1) * (count(DISTINCT c) - 1) AS DOUBLE) AS df FROM m) SELECT round(exp(-chi2 / 2), 6) AS p FROM s",
    )
    add(
        "nominal_lambda",
        lambda s, d: q(stats.nominal_lambda(lineitem(s, d), "l_returnflag", "l_linestatus")),
        f"WITH {table}, a AS (SELECT c, max(n) AS x, max(nc) AS nc, max(t) AS t FROM m GROUP BY c), b AS (SELECT r, max(n) AS x, max(nr) AS nr FROM m GROUP BY r), z AS (SELECT (SELECT sum(x) FROM a) AS bc, (SELECT max(nc) FROM a) AS tc, (SELECT max(t) FROM a) AS t, (SELECT sum(x) FROM b) AS br, (SELECT max(nr) FROM b) AS tr) "
        "SELECT round(coalesce((bc - tr) / nullif(t - tr, 0), 1.0), 6) AS row_dep, round(coalesce((br - tc) / nullif(t - tc, 0), 1.0), 6) AS col_dep, round(coalesce((br - tc + bc - tr) / nullif(2 * t - tr - tc, 0), 1.0), 6) AS symmetric FROM z",
    )
    add(
        "uncertainty_reduction",
        lambda s, d: q(stats.uncertainty(lineitem(s, d), "l_returnflag", "l_linestatus")),
        f"WITH {table}, z AS (SELECT (SELECT -sum(n / t * ln(n / t)) FROM m) AS hj, (SELECT -sum(nr / t * ln(nr / t)) FROM (SELECT DISTINCT r, nr, t FROM m)) AS hr, (SELECT -sum(nc / t * ln(nc / t)) FROM (SELECT DISTINCT c, nc, t FROM m)) AS hc) "
        "SELECT round((hr + hc - hj) / nullif(hr, 0), 6) AS row_dep, round((hr + hc - hj) / nullif(hc, 0), 6) AS col_dep, round(2 * (hr + hc - hj) / nullif(hr + hc, 0), 6) AS symmetric FROM z",
    )
    five = (0.01, 0.1, 0.5, 0.9, 0.99)
    at = lambda p: f"list_sort(list(r))[CAST(least(greatest(floor({p} * (count(*) + 1)) - 1, 0), count(*) - 1) AS INTEGER) + 1]"
    add(
        "order_quantiles",
        lambda s, d: q(returns(s, d).groupBy("symbol").agg(*[stats.order_quantile("r", p).alias(f"q{k}") for k, p in enumerate(five)], F.min("r").alias("low"), F.max("r").alias("high"), F.median("r").alias("median")), 8),
        sql("symbol, " + ", ".join(f"round({at(p)}, 8) AS q{k}" for k, p in enumerate(five)) + ", round(min(r), 8) AS low, round(max(r), 8) AS high, round(quantile_cont(r, 0.5), 8) AS median", RETURNS, "rr", "GROUP BY symbol"),
    )
    m = "avg(r) AS m, count(*) AS n"
    add(
        "online_moments",
        lambda s, d: q(returns(s, d).groupBy("symbol").agg(*stats.moments("r"))),
        sql(
            "symbol, n, round(m, 6) AS mean, round(v, 6) AS variance, round(c3 / pow(v, 1.5), 6) AS skewness, round(c4 / (v * v), 6) AS kurtosis",
            f"{RETURNS}, a AS (SELECT symbol, {m} FROM rr GROUP BY symbol), b AS (SELECT symbol, max(n) AS n, max(m) AS m, avg(pow(r - m, 2)) AS v, avg(pow(r - m, 3)) AS c3, avg(pow(r - m, 4)) AS c4 FROM rr JOIN a USING (symbol) GROUP BY symbol)",
            "b",
        ),
    )
    roc = f"{RETURNS}, p AS (SELECT symbol, i, {slope_sql(10)} AS v, lead(x) OVER {O} - x AS g FROM bars), o AS (SELECT symbol, i, round(v, 10) AS v, greatest(g, 0.0) AS w, greatest(-g, 0.0) AS l FROM p WHERE v IS NOT NULL AND g IS NOT NULL), z AS (SELECT symbol, l, w, sum(w) OVER (PARTITION BY symbol ORDER BY v DESC, i ROWS UNBOUNDED PRECEDING) AS won FROM o)"
    add(
        "roc_area",
        lambda s, d: q(stats.roc_area(tables.bars(s, d).withColumn("v", F.round(ind.slope("x", 10), 10)).withColumn("g", ind.targets("x")).dropna(subset=["v", "g"]), "v", "g", "i", by=["symbol"])),
        sql("symbol, round(CASE WHEN sum(w) <= 0 OR sum(l) <= 0 THEN 0.5 ELSE sum(won * l) / (sum(w) * sum(l)) END, 6) AS roc_area", roc, "z", "GROUP BY symbol"),
    )
    add(
        "relative_entropy",
        lambda s, d: q(stats.relative_entropy(returns(s, d), "r", 10, ["symbol"])),
        sql("symbol, round(-sum(c / n * ln(c / n)) / ln(10.0), 6) AS entropy", f"{RETURNS}, e AS (SELECT symbol, min(r) AS lo, max(r) AS hi, count(*) AS n FROM rr GROUP BY symbol), f AS (SELECT symbol, floor((10 - 1e-10) / (hi - lo + 1e-60) * (r - lo)) AS b, CAST(count(*) AS DOUBLE) AS c, max(n) AS n FROM rr JOIN e USING (symbol) GROUP BY 1, 2)", "f", "GROUP BY symbol"),
    )
    pair = f"p AS (SELECT symbol, {slope_sql(10)} AS a, lead(x, 5) OVER {O} - x AS b FROM bars), o AS (SELECT * FROM p WHERE a IS NOT NULL AND b IS NOT NULL)"
    add(
        "simple_regression",
        lambda s, d: q(stats.regression(tables.bars(s, d).withColumn("a", ind.slope("x", 10)).withColumn("b", ind.targets("x", 5)).dropna(subset=["a", "b"]), "a", "b", ["symbol"])),
        sql("symbol, round(regr_slope(b, a), 6) AS beta, round(regr_intercept(b, a), 6) AS constant", pair, "o", "GROUP BY symbol"),
    )
    wins, losses = "sum(greatest(r, 0.0))", "sum(greatest(-r, 0.0))"
    add(
        "return_criteria",
        lambda s, d: q(returns(s, d).groupBy("symbol").agg(*stats.criteria("r"))),
        sql(
            f"symbol, round(sum(r), 6) AS total, round(avg(r), 6) AS mean, round(({wins} + 1e-60) / ({losses} + 1e-60), 6) AS profit_factor, round(avg(r) / (stddev_pop(r) + 1e-60), 6) AS sharpe, round(({wins} + 1e-10) / ({losses} + 1e-10), 6) AS win_loss, round(ln(({wins} + 1e-10) / ({losses} + 1e-10)), 6) AS log_pf",
            RETURNS, "rr", "GROUP BY symbol",
        ),
    )
    add(
        "window_criteria",
        lambda s, d: q(
            (lambda df, w: df.where("i >= 99").select("symbol", "i", F.sum("r").over(w).alias("total"), (F.avg("r").over(w) / (F.stddev_pop("r").over(w) + 1e-60)).alias("sharpe")))(
                returns(s, d), ind.MARKET.last(50)
            )
        ),
        sql("symbol, i, round(sum(r) OVER w, 6) AS total, round(avg(r) OVER w / (stddev_pop(r) OVER w + 1e-60), 6) AS sharpe", RETURNS, "(SELECT * FROM rr WHERE i >= 99)", "WINDOW w AS (PARTITION BY symbol ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)"),
    )
    draw = f"{RETURNS}, c AS (SELECT symbol, i, sum(r) OVER (PARTITION BY symbol ORDER BY i ROWS UNBOUNDED PRECEDING) AS c FROM rr), p AS (SELECT symbol, c, max(c) OVER (PARTITION BY symbol ORDER BY i ROWS UNBOUNDED PRECEDING) AS p FROM c)"
    add("max_drawdown", lambda s, d: q(stats.drawdown(returns(s, d), "r", "i", ["symbol"])), sql("symbol, round(max(p - c), 6) AS max_drawdown, round(100 * (1 - exp(-max(p - c))), 6) AS drawdown_pct", draw, "p", "GROUP BY symbol"))
    perf = f"{RETURNS}, s AS (SELECT symbol, i, (exp(r) - 1) / 100 AS q FROM rr), e AS (SELECT symbol, i, q, exp(sum(ln(1 + q)) OVER (PARTITION BY symbol ORDER BY i ROWS UNBOUNDED PRECEDING)) AS e FROM s), k AS (SELECT *, greatest(max(e) OVER (PARTITION BY symbol ORDER BY i ROWS UNBOUNDED PRECEDING), 1.0) AS pk FROM e)"
    add(
        "performance_metrics",
        lambda s, d: q(stats.performance(returns(s, d).withColumn("q", (F.exp("r") - 1) / 100), "q", "i", ["symbol"]).withColumn("total_return", F.log1p("total_return")), 5),
        sql("symbol, round(sum(ln(1 + q)), 5) AS total_return, round(stddev_samp(q) * sqrt(252.0), 5) AS volatility, round(avg(q) * 252.0 / (stddev_samp(q) * sqrt(252.0)), 5) AS sharpe, round(max(1 - e / pk), 5) AS max_drawdown", perf, "k", "GROUP BY symbol"),
    )
    inverse_t = tail_sql.inverse(lambda x: tail_sql.t_cdf("n - 1.0", x), "0.9", "-10", "10")
    add(
        "t_summary",
        lambda s, d: q(stats.t_summary(returns(s, d), "r", ["symbol"])),
        sql(
            f"symbol, n, round(m, 6) AS mean, round(sd, 6) AS sd, round(t, 6) AS t, round(1 - {tail_sql.t_cdf('n - 1.0', 't')}, 6) AS p, round(m - sd / sqrt(n) * {inverse_t}, 6) AS lower",
            f"{RETURNS}, u AS (SELECT symbol, count(r) AS n, avg(r) AS m, stddev_samp(r) AS sd FROM rr GROUP BY symbol), tt AS (SELECT *, m / (sd / sqrt(n) + 1e-60) AS t FROM u)", "tt",
        ),
    )
    names = "SELECT upper(replace(p_brand, '#', '')) || CASE WHEN p_partkey % 7 = 0 THEN 'XAUUSDT' WHEN p_partkey % 7 = 1 THEN 'SPXUSDT' WHEN p_partkey % 7 = 2 THEN 'EUR' WHEN p_partkey % 7 = 3 THEN 'XUSDT' ELSE 'USDT' END AS symbol FROM part"
    likes = lambda c, parts: "(" + " OR ".join(f"contains({c}, '{p}')" for p in parts) + ")"
    classes = "CASE " + " ".join(f"WHEN {likes('symbol', p)} THEN '{n}'" for n, p in symbols.CLASSES) + " WHEN length(symbol) < 15 AND NOT contains(symbol, 'USDT') THEN 'possible stock' ELSE 'other' END"

    def symbol_names(s, d):
        tables.table(s, d, "part").createOrReplaceTempView("_part_names")
        return s.sql(names.replace("FROM part", "FROM _part_names"))

    add(
        "symbol_filters",
        lambda s, d: symbol_names(s, d).groupBy(symbols.classify(F.col("symbol")).alias("kind"), symbols.wanted(F.col("symbol")).alias("wanted"), symbols.not_crypto(F.col("symbol"), ["BRAND1", "BRAND2"]).alias("not_crypto")).agg(F.count(F.lit(1)).alias("n")),
        f"WITH s AS ({names}) SELECT {classes} AS kind, {likes('symbol', symbols.WANTED)} AND NOT {likes('symbol', symbols.UNWANTED)} AS wanted, NOT {likes('symbol', ('BRAND1', 'BRAND2'))} AS not_crypto, count(*) AS n FROM s GROUP BY ALL",
    )
    add(
        "symbol_allow_list",
        lambda s, d: symbol_names(s, d).unionByName(s.createDataFrame([(x,) for x in symbols.ALLOWED], "symbol string")).where(symbols.allowed(F.col("symbol"))).select("symbol", symbols.likely_stock(F.col("symbol")).alias("stock")).distinct(),
        "SELECT symbol, ends_with(symbol, 'XUSDT') AS stock FROM (VALUES " + ", ".join(f"('{x}')" for x in symbols.ALLOWED) + ") t(symbol)",
    )
    add(
        "interval_table",
        lambda s, d: symbols.interval_table(s).select("code", "folder", "millis", symbols.time_text(F.col("code"), F.lit(1_700_000_000_000)).alias("stamp")),
        "SELECT * FROM (VALUES " + ", ".join(f"('{c}', '{f}', CAST({m} AS BIGINT), '{'20231114' if c in 'DWM' else '20231114 22:13:20'}')" for c, _, f, m in symbols.INTERVALS) + ") t(code, folder, millis, stamp)",
    )

    # over whole tables without a key, or over series of any length
    probs = (0.001, 0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99, 0.999)
    levels = f"SELECT unnest([{', '.join(map(repr, probs))}])::DOUBLE AS prob"
    place = "least(greatest(CAST(floor(prob * (n + 1)) AS BIGINT), 1), n)"

    def price_quantiles(by):
        return lambda s, d: ordered.quantiles(lineitem(s, d), "l_extendedprice", probs, by)

    for name, by in (("price_quantiles", []), ("price_quantiles_by_flag", ["l_returnflag", "l_linestatus"])):
        keys = "".join(f"{c}, " for c in by)
        part = f"PARTITION BY {keys.rstrip(', ')}" if by else ""
        ranked = f"SELECT {keys}l_extendedprice AS v, row_number() OVER ({part} ORDER BY l_extendedprice) AS k, count(*) OVER ({part}) AS n FROM lineitem"
        add(name, price_quantiles(by), f"WITH p AS ({levels}), r AS ({ranked}) SELECT {keys}prob, n, v AS quantile FROM r, p WHERE k = {place}")
    rest = lambda s, d: lineitem(s, d).select((F.pmod(F.round(F.col("l_extendedprice") * 100).cast("long"), F.lit(100003)) / 100003.0).alias("v"))
    spread = "u AS (SELECT v, row_number() OVER (ORDER BY v) AS k, count(*) OVER () AS n FROM (SELECT CAST(round(l_extendedprice * 100) AS BIGINT) % 100003 / 100003.0::DOUBLE AS v FROM lineitem))"
    add("ks_uniform_all", lambda s, d: q(stats.ks_uniform(rest(s, d), "v"), 9), f"WITH {spread} SELECT round(max(k / n - v), 9) AS d_plus, round(max(v - (k - 1) / n), 9) AS d_minus FROM u")
    whole_ad = f"{spread}, s AS (SELECT max(n) AS n, sum((2 * k - 1) * ln(greatest(v, 1e-30)) + (2 * (n + 1 - k) - 1) * ln(greatest(1 - v, 1e-30))) AS s FROM u), a AS (SELECT -n - s / n AS a2 FROM s)"
    add("anderson_darling_all", lambda s, d: q(stats.anderson_darling(rest(s, d), "v"), 4), f"WITH {whole_ad} SELECT round(a2, 4) AS a2, round({dist.anderson_darling_sql('a2')}, 4) AS p FROM a")
    whole = ranks.replace("PARTITION BY l_returnflag, l_quantity", "PARTITION BY l_extendedprice").replace("PARTITION BY l_returnflag ", "").replace("l_quantity", "l_extendedprice")
    add(
        "mann_whitney_all",
        lambda s, d: q(stats.mann_whitney(lineitem(s, d), "l_extendedprice", F.col("l_linestatus") == "F"), 4),
        f"WITH a AS ({whole}), b AS (SELECT CAST(count(*) FILTER (l_linestatus = 'F') AS DOUBLE) AS n1, CAST(count(*) FILTER (l_linestatus <> 'F') AS DOUBLE) AS n2, sum(rk) FILTER (l_linestatus = 'F') AS r1, sum(CAST(td AS DOUBLE) * td - 1) AS ties FROM a), "
        "c AS (SELECT *, n1 + n2 AS n, n1 * n2 + n1 * (n1 + 1) / 2 - r1 AS u FROM b) SELECT round(u, 4) AS u, round((u - n1 * n2 / 2) / sqrt(n1 * n2 / (n * (n - 1)) * ((n * n * n - n) / 12 - ties / 12)), 4) AS z FROM c",
    )
    gain, tie = "l_discount - 0.05", "l_orderkey * 8 + l_linenumber"
    won = "SELECT greatest(g, 0.0) AS w, greatest(-g, 0.0) AS l, sum(greatest(g, 0.0)) OVER (ORDER BY p DESC, t ROWS UNBOUNDED PRECEDING) AS won FROM (SELECT l_extendedprice AS p, round(l_discount - 0.05, 2) AS g, " + tie + " AS t FROM lineitem)"
    add(
        "roc_area_all",
        lambda s, d: q(stats.roc_area(lineitem(s, d).select("l_extendedprice", F.expr(f"round({gain}, 2)").alias("g"), F.expr(tie).alias("t")), "l_extendedprice", "g", "t")),
        f"WITH z AS ({won}) SELECT round(CASE WHEN sum(w) <= 0 OR sum(l) <= 0 THEN 0.5 ELSE sum(won * l) / (sum(w) * sum(l)) END, 6) AS roc_area FROM z",
    )
    ticks = "WITH RECURSIVE tk AS (SELECT event_type AS symbol, event_id AS seq, value AS x, CAST(row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS INTEGER) AS i FROM events), "
    tick_series = lambda s, d: ordered.series(tables.ticks(s, d), "price", ["symbol"], ["ts", "seq"])
    add(
        "tick_ema",
        lambda s, d: q(ordered.ema(tick_series(s, d), 50, ["symbol"]).select("symbol", "seq", "i", "ema")),
        ticks + ema_sql(50, "tk") + " SELECT t.symbol, t.seq, CAST(t.i AS BIGINT) AS i, round(e.e, 6) AS ema FROM tk t LEFT JOIN e ON e.symbol = t.symbol AND e.i = t.i",
    )
    wilder = """d AS (SELECT symbol, i, greatest(x - lag(x) OVER w, 0.0) AS g, greatest(lag(x) OVER w - x, 0.0) AS l FROM tk WINDOW w AS (PARTITION BY symbol ORDER BY i)),
r AS (SELECT symbol, CAST(14 AS INTEGER) AS i, avg(g) AS g, avg(l) AS l FROM d WHERE i BETWEEN 1 AND 14 GROUP BY symbol HAVING count(*) = 14
  UNION ALL SELECT b.symbol, b.i, (p.g * 13 + b.g) / 14, (p.l * 13 + b.l) / 14 FROM r p JOIN d b ON b.symbol = p.symbol AND b.i = p.i + 1)"""
    add(
        "tick_rsi",
        lambda s, d: q(ordered.rsi_wilder(tick_series(s, d), 14, ["symbol"]).select("symbol", "seq", "i", "rsi")),
        ticks + wilder + " SELECT t.symbol, t.seq, CAST(t.i AS BIGINT) AS i, round(CASE WHEN r.l = 0 THEN 100.0 ELSE 100.0 - 100.0 / (1.0 + r.g / r.l) END, 6) AS rsi FROM tk t LEFT JOIN r ON r.symbol = t.symbol AND r.i = t.i",
    )
    lines = ", ".join([ema_sql(12, "tk", name="f"), ema_sql(26, "tk", name="s"), "m AS (SELECT f.symbol, f.i, f.e - s.e AS v FROM f JOIN s ON s.symbol = f.symbol AND s.i = f.i)", ema_sql(9, "m", "v", "g", "25")])
    add(
        "tick_macd",
        lambda s, d: q(ordered.macd(tick_series(s, d), 12, 26, 9, ["symbol"]).select("symbol", "seq", "i", "macd", "signal", "histogram")),
        ticks + lines + " SELECT t.symbol, t.seq, CAST(t.i AS BIGINT) AS i, round(m.v, 6) AS macd, round(g.e, 6) AS signal, round(m.v - g.e, 6) AS histogram FROM tk t LEFT JOIN m ON m.symbol = t.symbol AND m.i = t.i LEFT JOIN g ON g.symbol = t.symbol AND g.i = t.i",
    )
