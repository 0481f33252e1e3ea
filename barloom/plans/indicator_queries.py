"""Bars, indicators and recurrences."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import indicators as ind, recurrences as rec
from ..sources import tables
from . import catalog


def w(n: int, end: int = 0) -> str:
    last = "CURRENT ROW" if end == 0 else f"{-end} PRECEDING"
    return f"(PARTITION BY symbol ORDER BY i ROWS BETWEEN {n - 1 - end if end else n - 1} PRECEDING AND {last})"


O = "(PARTITION BY symbol ORDER BY i)"  # noqa: E741


def full(n: int, e: str) -> str:
    return f"CASE WHEN i >= {n - 1} THEN {e} END"


def sql(select: str, ctes: str = "", source: str = "bars", tail: str = "") -> str:
    return f"WITH RECURSIVE {catalog.BARS_SQL}{', ' + ctes if ctes else ''} SELECT {select} FROM {source} {tail}"


def slope_sql(n: int) -> str:
    return full(n, f"regr_slope(x, CAST(i AS DOUBLE)) OVER {w(n)}")


def atr_sql(n: int) -> str:
    return full(n, f"(sum(tr) OVER {w(n - 1)} + lag(hl, {n - 1}) OVER {O}) / {n}")


TR = f"t AS (SELECT *, lh - ll AS hl, greatest(lh - ll, lh - lag(x) OVER {O}, lag(x) OVER {O} - ll) AS tr FROM bars)"


def expansion_sql(n: int) -> str:
    half = n // 2
    recent = f"(PARTITION BY symbol ORDER BY i ROWS BETWEEN {n - half - 1} PRECEDING AND CURRENT ROW)"
    old = f"(PARTITION BY symbol ORDER BY i ROWS BETWEEN {n - 1} PRECEDING AND {n - half} PRECEDING)"
    return full(n, f"(max(x) OVER {recent} - min(x) OVER {recent}) / (max(x) OVER {old} - min(x) OVER {old} + 1e-10)")


def jump_sql(n: int) -> str:
    before = f"list(x) OVER (PARTITION BY symbol ORDER BY i ROWS BETWEEN {n - 1} PRECEDING AND 1 PRECEDING)"
    return full(n, f"x - list_reduce({before}, lambda a, v: a + (v - a) * {2.0 / n!r})")


def versions_sql(make, lookback: int, source: str, ctes: str = "") -> str:
    held = f"v AS (SELECT symbol, i, {make(lookback)} AS a, {make(2 * lookback)} AS b FROM {source})"
    return sql(
        f"symbol, i, round(a, 8) AS v0, round(a - lag(a, {lookback}) OVER {O}, 8) AS v1, round(a - b, 8) AS v2",
        (ctes + ", " if ctes else "") + held, "v",
    )


def three(make, lookback: int, prepare=lambda df: df):
    def query(spark, sf_dir):
        df = prepare(tables.bars(spark, sf_dir))
        df = df.withColumn("_a", make(lookback)).withColumn("_b", make(2 * lookback))
        return df.select(
            "symbol", "i", F.round("_a", 8).alias("v0"), F.round(F.col("_a") - ind.MARKET.lag("_a", lookback), 8).alias("v1"), F.round(F.col("_a") - F.col("_b"), 8).alias("v2")
        )

    return query


def one(name, make, prepare=lambda df: df):
    """A query of a single indicator column."""
    return lambda spark, sf_dir: prepare(tables.bars(spark, sf_dir)).select("symbol", "i", F.round(make(), 6).alias(name))


def ema_sql(n: int, source: str = "bars", value: str = "x", name: str = "e", first: str = "0") -> str:
    """CTE text of an exponential average: seeded by the mean of the first n values from place ``first`` on."""
    alpha = 2.0 / (n + 1)
    return f"""{name} AS (
  SELECT symbol, CAST({first} + {n - 1} AS INTEGER) AS i, avg({value}) AS e FROM {source} WHERE i >= {first} AND i < {first} + {n} GROUP BY symbol HAVING count(*) = {n}
  UNION ALL SELECT b.symbol, b.i, p.e + (b.{value} - p.e) * {alpha!r} FROM {name} p JOIN {source} b ON b.symbol = p.symbol AND b.i = p.i + 1)"""


def wilder_sql(n: int, name: str = "r") -> str:
    return f"""d AS (SELECT symbol, i, greatest(x - lag(x) OVER {O}, 0.0) AS g, greatest(lag(x) OVER {O} - x, 0.0) AS l FROM bars),
{name} AS (
  SELECT symbol, CAST({n} AS INTEGER) AS i, avg(g) AS g, avg(l) AS l FROM d WHERE i BETWEEN 1 AND {n} GROUP BY symbol HAVING count(*) = {n}
  UNION ALL SELECT b.symbol, b.i, (p.g * {n - 1} + b.g) / {n}, (p.l * {n - 1} + b.l) / {n} FROM {name} p JOIN d b ON b.symbol = p.symbol AND b.i = p.i + 1)"""


def rsi_ema_sql(n: int, start: int) -> str:
    return f"""d AS (SELECT symbol, i, greatest(x - lag(x) OVER {O}, 0.0) AS g, greatest(lag(x) OVER {O} - x, 0.0) AS l FROM bars),
seed AS (SELECT symbol, avg(g) AS g, avg(l) AS l FROM d WHERE i BETWEEN {start - n + 1} AND {start} GROUP BY symbol HAVING count(*) = {n}),
r AS (
  SELECT d.symbol, d.i, (s.g * {n - 1} + d.g) / {n} AS g, (s.l * {n - 1} + d.l) / {n} AS l FROM seed s JOIN d ON d.symbol = s.symbol AND d.i = {start}
  UNION ALL SELECT b.symbol, b.i, (p.g * {n - 1} + b.g) / {n}, (p.l * {n - 1} + b.l) / {n} FROM r p JOIN d b ON b.symbol = p.symbol AND b.i = p.i + 1)"""


def register(add) -> None:
    add(
        "crossover_return",
        lambda s, d: tables.bars(s, d).withColumn("_c", ind.ma_cross("x", 5, 20)).withColumn("_n", ind.targets("x"))
        .where("_c IS NOT NULL AND _n IS NOT NULL").groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.signum("_c") * F.col("_n")), 6).alias("total")),
        sql(
            "symbol, count(*) AS n, round(sum(sign(c) * nx), 6) AS total",
            f"c AS (SELECT symbol, {full(20, f'avg(x) OVER {w(5)} - avg(x) OVER {w(20)}')} AS c, lead(x) OVER {O} - x AS nx FROM bars)",
            "c", "WHERE c IS NOT NULL AND nx IS NOT NULL GROUP BY symbol",
        ),
    )
    add(
        "daily_bars",
        lambda s, d: tables.bars(s, d).select("symbol", "i", "open", "high", "low", "close", "volume", F.round("x", 8).alias("x")),
        sql("symbol, i, open, high, low, close, volume, round(x, 8) AS x"),
    )
    add("log_prices", one("x", lambda: F.log("close")), sql("symbol, i, round(ln(close), 6) AS x"))
    add(
        "targets_and_returns",
        lambda s, d: tables.bars(s, d).select(
            "symbol", "i", F.round(ind.targets("x"), 8).alias("target"), F.round(F.col("close") / ind.MARKET.lag("close") - 1, 8).alias("simple"), F.round(F.col("x") - ind.MARKET.lag("x"), 8).alias("logret")
        ),
        sql(f"symbol, i, round(lead(x) OVER {O} - x, 8) AS target, round(close / lag(close) OVER {O} - 1, 8) AS simple, round(x - lag(x) OVER {O}, 8) AS logret"),
    )
    add("sma", one("sma", lambda: ind.sma("x", 10)), sql(f"symbol, i, round({full(10, f'avg(x) OVER {w(10)}')}, 6) AS sma"))
    add("ema", lambda s, d: catalog.rounded(rec.ema(tables.bars(s, d), 12).drop("x")), sql("b.symbol, b.i, round(e.e, 6) AS ema", ema_sql(12), "bars b LEFT JOIN e ON e.symbol = b.symbol AND e.i = b.i"))
    add("ma_crossover", one("cross", lambda: ind.ma_cross("x", 5, 20)), sql(f"symbol, i, round({full(20, f'avg(x) OVER {w(5)} - avg(x) OVER {w(20)}')}, 6) AS \"cross\""))
    add("linear_slope", one("slope", lambda: ind.slope("x", 10)), sql(f"symbol, i, round({slope_sql(10)}, 6) AS slope"))
    add("trend_versions", three(lambda n: ind.slope("x", n), 10), versions_sql(slope_sql, 10, "bars"))
    tr = lambda df: ind.with_true_range(df, "lh", "ll", "x")
    add("atr", one("atr", lambda: ind.atr_of(14), tr), sql(f"symbol, i, round({atr_sql(14)}, 6) AS atr", TR, "t"))
    add("volatility_versions", three(ind.atr_of, 10, tr), versions_sql(atr_sql, 10, "t", TR))
    add("range_expansion", one("expansion", lambda: ind.range_expansion("x", 10)), sql(f"symbol, i, round({expansion_sql(10)}, 6) AS expansion"))
    add("expansion_versions", three(lambda n: ind.range_expansion("x", n), 10), versions_sql(expansion_sql, 10, "bars"))
    add("price_jump", one("jump", lambda: ind.price_jump("x", 10)), sql(f"symbol, i, round({jump_sql(10)}, 6) AS jump"))
    add("jump_versions", three(lambda n: ind.price_jump("x", n), 10), versions_sql(jump_sql, 10, "bars"))
    add(
        "rsi_wilder",
        lambda s, d: catalog.rounded(rec.rsi_wilder(tables.bars(s, d), 14).drop("x")),
        sql("b.symbol, b.i, round(CASE WHEN r.l = 0 THEN 100.0 ELSE 100.0 - 100.0 / (1.0 + r.g / r.l) END, 6) AS rsi", wilder_sql(14), "bars b LEFT JOIN r ON r.symbol = b.symbol AND r.i = b.i"),
    )
    gains = f"d AS (SELECT symbol, i, avg(greatest(x - p, 0.0)) OVER {w(14)} AS g, avg(greatest(p - x, 0.0)) OVER {w(14)} AS l FROM (SELECT *, lag(x) OVER {O} AS p FROM bars) q)"
    add(
        "rsi_simple",
        one("rsi", lambda: ind.rsi_simple(14), lambda df: ind.with_changes(df, "x").where("i >= 1 OR i = 0")),
        sql("symbol, i, round(CASE WHEN i < 14 THEN 0.0 ELSE ((CASE WHEN g < 1e-10 AND l < 1e-10 THEN 50.0 WHEN l < 1e-10 THEN 100.0 ELSE 100.0 - 100.0 / (1.0 + g / l) END) - 50.0) / 50.0 END, 6) AS rsi", gains, "d"),
    )
    add(
        "rsi_ema",
        lambda s, d: catalog.rounded(rec.rsi_ema(tables.bars(s, d), 14, 20).drop("x")),
        sql("b.symbol, b.i, round(coalesce(((CASE WHEN r.g < 1e-10 AND r.l < 1e-10 THEN 50.0 WHEN r.l < 1e-10 THEN 100.0 ELSE 100.0 - 100.0 / (1.0 + r.g / r.l) END) - 50.0) / 50.0, 0.0), 6) AS rsi", rsi_ema_sql(14, 20), "bars b LEFT JOIN r ON r.symbol = b.symbol AND r.i = b.i"),
    )
    macd_ctes = ",\n".join([ema_sql(12, name="f"), ema_sql(26, name="s"), "m AS (SELECT f.symbol, f.i, f.e - s.e AS v FROM f JOIN s ON s.symbol = f.symbol AND s.i = f.i)", ema_sql(9, "m", "v", "g", "25")])
    add(
        "macd",
        lambda s, d: catalog.rounded(rec.macd(tables.bars(s, d), 12, 26, 9).drop("x")),
        sql("b.symbol, b.i, round(m.v, 6) AS macd, round(g.e, 6) AS signal, round(m.v - g.e, 6) AS histogram", macd_ctes, "bars b LEFT JOIN m ON m.symbol = b.symbol AND m.i = b.i LEFT JOIN g ON g.symbol = b.symbol AND g.i = b.i"),
    )

    def bands(s, d):
        lo, mid, hi = ind.bollinger("x", 20, 2.0)
        return tables.bars(s, d).select("symbol", "i", F.round(lo, 6).alias("lower_band"), F.round(mid, 6).alias("middle_band"), F.round(hi, 6).alias("upper_band"))

    mid, dev = f"avg(x) OVER {w(20)}", f"stddev_pop(x) OVER {w(20)}"
    add("bollinger", bands, sql(f"symbol, i, round({full(20, f'{mid} - 2.0 * {dev}')}, 6) AS lower_band, round({full(20, mid)}, 6) AS middle_band, round({full(20, f'{mid} + 2.0 * {dev}')}, 6) AS upper_band"))
    typical = "(high + low + close) / 3"
    cci_ctes = f"p AS (SELECT symbol, i, {typical} AS t, avg({typical}) OVER {w(20)} AS m, list({typical}) OVER {w(20)} AS f FROM bars), q AS (SELECT symbol, i, t, m, list_sum(list_transform(f, lambda v: abs(v - m))) / 20 AS dv FROM p)"
    add("cci", one("cci", lambda: ind.cci("high", "low", "close", 20)), sql(f"symbol, i, round({full(20, 'CASE WHEN dv < 1e-10 THEN 0.0 ELSE (t - m) / (0.015 * dv) END')}, 6) AS cci", cci_ctes, "q"))
    top, bottom = f"max(high) OVER {w(14)}", f"min(low) OVER {w(14)}"
    k_cte = f"k AS (SELECT symbol, i, {full(14, f'CASE WHEN {top} = {bottom} THEN 50.0 ELSE (close - {bottom}) / ({top} - {bottom}) * 100 END')} AS k FROM bars)"
    add(
        "stochastic",
        lambda s, d: catalog.rounded(ind.stochastic(tables.bars(s, d), "high", "low", "close", 14, 3).select("symbol", "i", "stoch_k", "stoch_d")),
        sql(f"symbol, i, round(k, 6) AS stoch_k, round({full(16, f'avg(k) OVER {w(3)}')}, 6) AS stoch_d", k_cte, "k"),
    )
    add(
        "obv",
        lambda s, d: catalog.rounded(ind.obv(tables.bars(s, d), "close", "volume").select("symbol", "i", "obv")),
        sql(f"symbol, i, round(sum(coalesce(sg * volume, 0.0)) OVER (PARTITION BY symbol ORDER BY i ROWS UNBOUNDED PRECEDING), 6) AS obv", f"q AS (SELECT *, sign(close - lag(close) OVER {O}) AS sg FROM bars)", "q"),
    )
    add("roc", one("roc", lambda: ind.roc("close", 10)), sql(f"symbol, i, round((close - lag(close, 10) OVER {O}) / nullif(lag(close, 10) OVER {O}, 0), 6) AS roc"))
    cross_ctes = ",\n".join([
        ema_sql(5, name="e5"), ema_sql(15, name="e15"), wilder_sql(5, "r5"),
        wilder_sql(15, "r15").split(",\n", 1)[1],
        "m AS (SELECT f.symbol, f.i, f.e - s.e AS v FROM e5 f JOIN e15 s ON s.symbol = f.symbol AND s.i = f.i)", ema_sql(9, "m", "v", "g", "14"),
        f"q AS (SELECT symbol, i, {full(15, f'avg(x) OVER {w(5)} - avg(x) OVER {w(15)}')} AS ma, (x - lag(x, 5) OVER {O}) / lag(x, 5) OVER {O} - (x - lag(x, 15) OVER {O}) / lag(x, 15) OVER {O} AS roc FROM bars)",
    ])
    rsi_of = lambda t: f"(CASE WHEN {t}.l = 0 THEN 100.0 ELSE 100.0 - 100.0 / (1.0 + {t}.g / {t}.l) END)"
    add(
        "crossover_family",
        lambda s, d: catalog.rounded(rec.crossovers(tables.bars(s, d), 5, 15).drop("x"), 5),
        sql(
            f"q.symbol, q.i, round(q.ma, 5) AS ma, round({rsi_of('r5')} - {rsi_of('r15')}, 5) AS rsi, round(e5.e - e15.e, 5) AS ema, round(q.roc, 5) AS roc, round(m.v - g.e, 5) AS macd",
            cross_ctes,
            "q " + " ".join(f"LEFT JOIN {t} ON {t}.symbol = q.symbol AND {t}.i = q.i" for t in ("r5", "r15", "e5", "e15", "m", "g")),
        ),
    )
    add(
        "spec_grid",
        lambda s, d: ind.spec_grid(s, ["Ma", "Rsi", "Macd"], 10, 3, 2),
        "SELECT CAST(t.n * 6 + a * 2 + b AS INTEGER) AS k, t.type, CAST(greatest(1, ((a + 1) * 10 * (b + 1)) // 3) AS INTEGER) AS short_lookback, CAST((a + 1) * 10 AS INTEGER) AS long_lookback "
        "FROM (VALUES (0, 'Ma'), (1, 'Rsi'), (2, 'Macd')) t(n, type), range(3) u(a), range(2) v(b)",
    )
    pairs = [(2, 6), (4, 6), (4, 12), (8, 12)]
    add(
        "feature_matrix",
        lambda s, d: catalog.rounded(
            tables.bars(s, d).select("symbol", "i", *[ind.ma_cross("x", a, b).alias(f"f{a}_{b}") for a, b in pairs], ind.slope("x", 10).alias("slope"), ind.targets("x").alias("target")).dropna(), 8
        ),
        sql(
            "symbol, i, " + ", ".join(f"round(f{a}_{b}, 8) AS f{a}_{b}" for a, b in pairs) + ", round(slope, 8) AS slope, round(target, 8) AS target",
            "q AS (SELECT symbol, i, " + ", ".join(f"{full(b, f'avg(x) OVER {w(a)} - avg(x) OVER {w(b)}')} AS f{a}_{b}" for a, b in pairs) + f", {slope_sql(10)} AS slope, lead(x) OVER {O} - x AS target FROM bars)",
            "q", "WHERE i >= 11 AND target IS NOT NULL",
        ),
    )
    add(
        "indicator_target_pair",
        lambda s, d: tables.bars(s, d).select("symbol", "i", F.round(ind.slope("x", 10) * 4.5, 8).alias("indicator"), F.round(ind.targets("x", 5), 8).alias("target")).dropna(),
        sql(f"symbol, i, round(v * 4.5, 8) AS indicator, round(t, 8) AS target", f"q AS (SELECT symbol, i, {slope_sql(10)} AS v, lead(x, 5) OVER {O} - x AS t FROM bars)", "q", "WHERE v IS NOT NULL AND t IS NOT NULL"),
    )
    clean = f"""v AS (SELECT symbol, i, {slope_sql(10)} AS v FROM bars), h AS (SELECT * FROM v WHERE v IS NOT NULL),
n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY v) AS r, greatest(CAST(floor(count(*) OVER (PARTITION BY symbol) * (1 - 2 * 0.05)) AS INTEGER) - 1, 0) AS sp FROM h),
c AS (SELECT a.symbol, a.v AS lo, b.v AS hi, row_number() OVER (PARTITION BY a.symbol ORDER BY b.v - a.v, a.r) AS k FROM n a JOIN n b ON b.symbol = a.symbol AND b.r = a.r + a.sp),
e AS (SELECT symbol, lo, hi, greatest(hi - lo, 1e-30) AS w FROM c WHERE k = 1)"""
    add(
        "clean_tails",
        lambda s, d: catalog.rounded(ind.clean_tails(tables.bars(s, d).withColumn("v", ind.slope("x", 10)), "v", 0.05).select("symbol", "i", "cleaned"), 8),
        sql("h.symbol, h.i, round(CASE WHEN v < lo THEN lo - 0.1 * w * (1 - exp(-(lo - v) / w)) WHEN v > hi THEN hi + 0.1 * w * (1 - exp(-(v - hi) / w)) ELSE v END, 8) AS cleaned", clean, "h JOIN e ON e.symbol = h.symbol"),
    )
    add(
        "train_test_split",
        lambda s, d: tables.bars(s, d).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("symbol"))).groupBy("symbol").agg(
            F.sum((F.col("i") < F.col("n") - 252).cast("long")).alias("n_train"), F.sum((F.col("i") >= F.col("n") - 252 - 201).cast("long")).alias("n_test"), F.round(F.avg(F.when(F.col("i") < F.col("n") - 252, F.col("x"))), 6).alias("train_mean")
        ),
        sql("symbol, CAST(sum(CASE WHEN i < n - 252 THEN 1 ELSE 0 END) AS BIGINT) AS n_train, CAST(sum(CASE WHEN i >= n - 453 THEN 1 ELSE 0 END) AS BIGINT) AS n_test, round(avg(CASE WHEN i < n - 252 THEN x END), 6) AS train_mean", "q AS (SELECT *, count(*) OVER (PARTITION BY symbol) AS n FROM bars)", "q", "GROUP BY symbol"),
    )
    runs = f"""v AS (SELECT symbol, i, {slope_sql(10)} AS v FROM bars), a AS (SELECT symbol, i, v >= 0 AS above FROM v WHERE v IS NOT NULL),
f AS (SELECT *, CASE WHEN above <> lag(above) OVER {O} THEN 1 WHEN lag(above) OVER {O} IS NULL THEN 1 ELSE 0 END AS nw FROM a),
g AS (SELECT *, sum(nw) OVER (PARTITION BY symbol ORDER BY i ROWS UNBOUNDED PRECEDING) AS run FROM f), l AS (SELECT symbol, above, run, count(*) AS len FROM g GROUP BY ALL)"""
    add(
        "gap_analysis",
        lambda s, d: ind.runs(tables.bars(s, d).withColumn("v", ind.slope("x", 10)), "v", F.lit(0.0)),
        sql("symbol, above, CAST(CASE WHEN len > 512 THEN 1024 ELSE pow(2, ceil(log2(len))) END AS INTEGER) AS bucket, count(*) AS n", runs, "l", "GROUP BY ALL"),
    )
    add(
        "align_markets",
        lambda s, d: (lambda b: b.join(b.groupBy("dt").agg(F.count(F.lit(1)).alias("k")).where("k = 5").select("dt"), "dt", "left_semi").groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("close"), 4).alias("closes")))(tables.daily_bars(s, d)),
        sql("symbol, count(*) AS n, round(sum(close), 4) AS closes", "", "bars0", "WHERE dt IN (SELECT dt FROM bars0 GROUP BY dt HAVING count(*) = 5) GROUP BY symbol"),
    )
    names = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
    add(
        "pivot_closes",
        lambda s, d: tables.daily_bars(s, d).groupBy("dt").pivot("symbol", names).agg(F.first("close")).select(F.date_format("dt", "yyyyMMdd").alias("day"), *[F.col(f"`{n}`").alias(f"c{k}") for k, n in enumerate(names)]),
        sql("strftime(dt, '%Y%m%d') AS day, " + ", ".join(f"max(CASE WHEN symbol = '{n}' THEN close END) AS c{k}" for k, n in enumerate(names)), "", "bars0", "GROUP BY dt"),
    )
