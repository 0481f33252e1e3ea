"""Bootstrap, permutation, selection bias."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from ..functions import dist, rng
from ..operators import grids, indicators as ind, resample, statistics
from ..sources import tables
from . import catalog
from .grid_queries import MOST, rows_sql
from .indicator_queries import O, sql

REPS, SEED = 60, 11
PROBS = (0.025, 0.05, 0.10)


def returns(spark, sf_dir):
    """Every market's returns, places from 0."""
    return tables.bars(spark, sf_dir).withColumn("r", ind.targets("x")).where("r IS NOT NULL").select("symbol", "i", "r")


RET = f"ret AS (SELECT symbol, i, r FROM (SELECT symbol, i, lead(x) OVER {O} - x AS r FROM bars) z WHERE r IS NOT NULL)"
LEVELS = "lv(prob) AS (VALUES " + ", ".join(f"({p}::DOUBLE)" for p in PROBS) + ")"
PICK = "greatest(CAST(floor(prob * (b + 1)) AS INTEGER), 1)"
DD = (0.999, 0.99, 0.95, 0.90)


def draws_sql(name: str, source: str, by: str, reps: int, seed: int, size: str = "n") -> str:
    """``name``: by, rep, j, i drawn with replacement; ``by`` has its trailing comma."""
    return f"{name}_n AS (SELECT {by} count(*) AS n FROM {source} GROUP BY ALL), {name} AS (SELECT {by} CAST(rep AS INTEGER) AS rep, CAST(j AS INTEGER) AS j, CAST({rng.bits_sql(seed, 'rep', 'j')} % n AS INTEGER) AS i FROM {name}_n, range({reps}) a(rep), range({size}) b(j))"


def sorted_sql(source: str, by: str, reps: int, seed: int, value: str = "r") -> str:
    """``so``: by, s (sorted means of resamples), b (how many)."""
    return f"{draws_sql('dr', source, by, reps, seed)}, st AS (SELECT {by} rep, avg({value}) AS stat FROM dr JOIN {source} USING ({by} i) GROUP BY ALL), so AS (SELECT {by} list_sort(list(stat)) AS s, count(*) AS b FROM st GROUP BY ALL)"


def bca_sql(by: str) -> str:
    """``bc``: by, prob, lo, hi from ``so`` (by, s, b) and ``th`` (by, t, a): the estimate and the acceleration."""
    inv, cdf = dist.inverse_normal_sql, dist.normal_cdf_sql
    return f"""sh AS (SELECT {by} t, a, s, b, CAST(greatest(least(len(list_filter(s, lambda v: v < t)), b - 1), 1) AS DOUBLE) / b AS share FROM so JOIN th USING ({by.rstrip(', ')})),
zz AS (SELECT {by} s, b, a, prob, {inv('share')} AS z0, {inv('prob')} AS zl, {inv('(1.0E0 - prob)')} AS zh FROM sh, lv),
yy AS (SELECT {by} s, b, prob, z0 + (z0 + zl) / (1 - a * (z0 + zl)) AS l, z0 + (z0 + zh) / (1 - a * (z0 + zh)) AS h FROM zz),
xx AS (SELECT {by} s, b, prob, {cdf('l')} AS al, {cdf('h')} AS ah FROM yy),
bc AS (SELECT {by} prob, s[least(greatest(CAST(floor(al * (b + 1)) AS INTEGER), 1), b)] AS lo, s[greatest(b + 1 - greatest(CAST(floor((1 - ah) * (b + 1)) AS INTEGER), 1), 1)] AS hi FROM xx)"""


def accel_sql(value: str) -> str:
    """The acceleration as an aggregate of leave-one-out values less their mean."""
    return f"sum(pow({value}, 3)) / (6 * pow(sqrt(sum(pow({value}, 2))), 3) + 1e-60)"


def mean_theta_sql(source: str, by: str, value: str = "r") -> str:
    """``th``: the mean and its acceleration; the mean of the leave-one-out means is the mean itself."""
    return f"tb AS (SELECT {by} avg({value}) AS t, count(*) AS n, sum({value}) AS sr FROM {source} GROUP BY ALL), th AS (SELECT {by} any_value(t) AS t, {accel_sql(f't - (sr - {value}) / (n - 1)')} AS a FROM {source} JOIN tb USING ({by.rstrip(', ')}) GROUP BY {by.rstrip(', ')})"


#: Sums of returns, and the values of statistics of sums whose names have a prefix.
SUM_NAMES = ("s0", "s1", "s2", "sw", "sl")
SUMS_OF = "count(*) AS s0, sum(r) AS s1, sum(r * r) AS s2, sum(greatest(r, 0.0)) AS sw, sum(greatest(-r, 0.0)) AS sl"
OWN = {
    "sharpe": lambda p: f"({p}s1 / {p}s0) / (sqrt(greatest({p}s2 / {p}s0 - ({p}s1 / {p}s0) * ({p}s1 / {p}s0), 0.0)) + 1e-60)",
    "profit_factor": lambda p: f"({p}sw + 1e-60) / ({p}sl + 1e-60)",
}


def own_sql(reps: int, seed: int) -> str:
    """``so`` and ``th`` of the statistics ``OWN``, for ``bca_sql`` by symbol and statistic."""
    less = "s0 - 1 AS ls0, s1 - r AS ls1, s2 - r * r AS ls2, sw - greatest(r, 0.0) AS lsw, sl - greatest(-r, 0.0) AS lsl"
    each = lambda source, keys, p="", tail="": " UNION ALL ".join(f"SELECT {keys}, '{name}' AS statistic, {value(p)} AS v{tail} FROM {source}" for name, value in OWN.items())
    return f"""{draws_sql('dr', 'ret', 'symbol, ', reps, seed)}, st AS (SELECT symbol, rep, {SUMS_OF} FROM dr JOIN ret USING (symbol, i) GROUP BY symbol, rep),
so AS (SELECT symbol, statistic, list_sort(list(v)) AS s, count(*) AS b FROM ({each('st', 'symbol')}) GROUP BY symbol, statistic),
tt AS (SELECT symbol, {SUMS_OF} FROM ret GROUP BY symbol), lo AS ({each(f"(SELECT symbol, {less} FROM ret JOIN tt USING (symbol))", 'symbol', 'l')}),
lm AS (SELECT symbol, statistic, v, avg(v) OVER (PARTITION BY symbol, statistic) - v AS d FROM lo), la AS (SELECT symbol, statistic, {accel_sql('d')} AS a FROM lm GROUP BY symbol, statistic),
th AS (SELECT symbol, statistic, v AS t, a FROM ({each('tt', 'symbol')}) JOIN la USING (symbol, statistic))"""


def drawdowns_sql(source: str, by: str, value: str, name: str = "w") -> str:
    """``name``: by, dd, the worst fall from a peak of each path in the order of j."""
    keys = by.rstrip(", ")
    return f"{name}_c AS (SELECT {by} j, sum({value}) OVER (PARTITION BY {keys} ORDER BY j ROWS UNBOUNDED PRECEDING) AS c FROM {source}), {name}_p AS (SELECT {by} c, max(c) OVER (PARTITION BY {keys} ORDER BY j ROWS UNBOUNDED PRECEDING) AS p FROM {name}_c), {name} AS (SELECT {by} max(p - c) AS dd FROM {name}_p GROUP BY {keys})"


def quantile_sql(value: str, q: str) -> str:
    """The order statistic floor(q (n + 1)), clamped, as an aggregate."""
    return f"list_sort(list({value}))[CAST(least(greatest(floor({q} * (count({value}) + 1)) - 1, 0), count({value}) - 1) AS INTEGER) + 1]"


def permuted_sql(reps: int, first: int, seed: int, source: str = "bars", joint: bool = False, cuts: tuple[int, ...] = ()) -> str:
    """``pm``: symbol, rep, i, x, as ``resample.permuted`` makes them."""
    hashed = rng.bits_sql(seed, "rep", "i") if joint else rng.bits_sql(seed, "symbol", "rep", "i")
    segment = " + ".join(["0", *[f"CASE WHEN i >= {c} THEN 1 ELSE 0 END" for c in cuts]])
    return f"""rp AS (SELECT CAST(r AS INTEGER) AS rep FROM range({reps}) g(r)),
stp AS (SELECT symbol, i, x, x - lag(x) OVER {O} AS st FROM {source}),
mv AS (SELECT symbol, rep, st, row_number() OVER (PARTITION BY symbol, rep ORDER BY {segment}, CASE WHEN rep = 0 THEN i ELSE {hashed} END, i) + {first} AS a FROM stp, rp WHERE i > {first}),
pm AS (SELECT symbol, rep, i, x FROM stp, rp WHERE i <= {first} UNION ALL SELECT m.symbol, m.rep, CAST(m.a AS INTEGER), b.x + sum(m.st) OVER (PARTITION BY m.symbol, m.rep ORDER BY m.a ROWS UNBOUNDED PRECEDING) FROM mv m JOIN {source} b ON b.symbol = m.symbol AND b.i = {first})"""


def grid_sql(source: str, key: str, most: int, select: str, own: bool = False, name: str = "gr") -> str:
    """``name``: key, short, long and ``select`` (aggregates of sg, ret) of the crossover grid over ``source``; ``key`` has its trailing comma."""
    by = f"(PARTITION BY {key.rstrip(', ')} ORDER BY i"
    start = "b.k - 1" if own else str(most - 1)
    return f"""{name}_s AS (SELECT {key} i, sum(x) OVER {by} ROWS UNBOUNDED PRECEDING) AS s, lead(x) OVER {by}) - x AS nx FROM {source}),
{name}_m AS (SELECT {key} i, nx, CAST(k AS INTEGER) AS k, (s - coalesce(lag(s, CAST(k AS INTEGER)) OVER (PARTITION BY {key} k ORDER BY i), 0.0)) / k AS m FROM {name}_s, range(1, {most + 1}) g(k)),
{name}_r AS (SELECT {', '.join('a.' + k.strip() for k in key.rstrip(', ').split(','))}, a.i, a.k AS short, b.k AS long, CAST(sign(a.m - b.m) AS INTEGER) AS sg, sign(a.m - b.m) * a.nx AS ret
  FROM {name}_m a JOIN {name}_m b ON {' AND '.join(f'b.{k.strip()} = a.{k.strip()}' for k in key.rstrip(', ').split(','))} AND b.i = a.i AND a.k < b.k WHERE a.nx IS NOT NULL AND a.i >= {start}),
{name} AS (SELECT {key} short, long, {select} FROM {name}_r GROUP BY ALL)"""


CSCV = "symbol, count(*) AS n_splits, round(avg(CASE WHEN rank / (n + 1) <= 0.5 THEN 1.0 ELSE 0.0 END), 6) AS probability"


def cscv_sql(m: int, blocks: int) -> str:
    """``rk``: symbol, split, rank of the best in-sample system among n out of sample."""
    place = f"(i - {m - 1})"
    short = f"(({blocks} - n % {blocks}) * (n // {blocks}))"
    block = f"CASE WHEN {place} < {short} THEN {place} // (n // {blocks}) ELSE {blocks} - n % {blocks} + ({place} - {short}) // (n // {blocks} + 1) END"
    halves = ", ".join(f"({k}, {b}, {str(b in inside).lower()})" for k, inside in enumerate(combinations(range(blocks), blocks // 2)) for b in range(blocks))
    return f"""{rows_sql(m)}, sz AS (SELECT symbol, max(i) - {m - 1} + 1 AS n FROM rows2 GROUP BY symbol),
bl AS (SELECT symbol, short, long, {block} AS block, sum(ret) AS s, count(*) AS c FROM rows2 JOIN sz USING (symbol) GROUP BY 1, 2, 3, 4),
hv(split, block, ins) AS (VALUES {halves}),
sc AS (SELECT symbol, split, short, long, sum(s) FILTER (ins) / sum(c) FILTER (ins) AS a, sum(s) FILTER (NOT ins) / sum(c) FILTER (NOT ins) AS o FROM bl JOIN hv USING (block) GROUP BY 1, 2, 3, 4),
tp AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY symbol, split ORDER BY round(a, 10) DESC, long, short) = 1),
rk AS (SELECT sc.symbol, sc.split, sum(CASE WHEN (sc.short = tp.short AND sc.long = tp.long) OR round(tp.o, 10) >= round(sc.o, 10) THEN 1 ELSE 0 END) AS rank, count(*) AS n FROM sc JOIN tp USING (symbol, split) GROUP BY 1, 2)"""


MCPT = "symbol, round(avg(CASE WHEN v >= v0 THEN 1.0 ELSE 0.0 END), 6) AS p_value, round(max(v0), 6) AS original, round(max(t0), 6) AS trend_component, round(avg(CASE WHEN rep > 0 THEN v - t END), 6) AS training_bias, round(max(v0) - avg(CASE WHEN rep > 0 THEN v - t END), 6) AS unbiased, round(max(v0) - avg(CASE WHEN rep > 0 THEN v - t END) - max(t0), 6) AS skill"
BASE = "SELECT a.*, b.v AS v0, b.t AS t0 FROM vt a JOIN vt b ON b.symbol = a.symbol AND b.rep = 0"


def means(spark, sf_dir):
    df = returns(spark, sf_dir)
    return df, resample.bootstrap(df, "r", ["symbol"], REPS, SEED, F.avg("r"))


def register(add) -> None:
    q = catalog.rounded
    by = ["symbol"]
    so = f"{RET}, {sorted_sql('ret', 'symbol, ', REPS, SEED)}, {LEVELS}"
    add("bootstrap_percentile", lambda s, d: q(resample.bounds(means(s, d)[1], PROBS, by), 8), sql(f"symbol, prob, round(s[{PICK}], 8) AS low, round(s[b + 1 - {PICK}], 8) AS high", so, "so, lv"))

    def pivot(s, d):
        df, stats = means(s, d)
        found = resample.bounds(stats, PROBS, by).join(df.groupBy("symbol").agg(F.avg("r").alias("_t")), "symbol")
        return q(resample.pivot(found, F.col("_t"), by), 8)

    add("bootstrap_pivot", pivot, sql(f"symbol, prob, round(2 * t - s[b + 1 - {PICK}], 8) AS low, round(2 * t - s[{PICK}], 8) AS high", f"{so}, tt AS (SELECT symbol, avg(r) AS t FROM ret GROUP BY symbol)", "so JOIN tt USING (symbol), lv"))
    add(
        "bootstrap_bca",
        lambda s, d: (lambda df, stats: q(resample.bca_of_mean(df, "r", stats, PROBS, by), 8))(*means(s, d)),
        sql("symbol, prob, round(lo, 8) AS low, round(hi, 8) AS high", f"{so}, {mean_theta_sql('ret', 'symbol, ')}, {bca_sql('symbol, ')}", "bc"),
    )
    own = {"sharpe": statistics.SHARPE, "profit_factor": statistics.PROFIT_FACTOR}
    add("bca_statistics", lambda s, d: q(statistics.bca(returns(s, d), own, "r", by, "i", REPS, SEED, PROBS), 8), sql("symbol, statistic, prob, round(lo, 8) AS low, round(hi, 8) AS high", f"{RET}, {own_sql(REPS, SEED)}, {LEVELS}, {bca_sql('symbol, statistic, ')}", "bc"))
    folds_of = f"""{RET}, fn AS (SELECT symbol, i, r, count(*) OVER (PARTITION BY symbol) AS n FROM ret), ff AS (SELECT symbol, r, CASE WHEN i < (n % 8) * (n // 8 + 1) THEN i // (n // 8 + 1) ELSE n % 8 + (i - (n % 8) * (n // 8 + 1)) // (n // 8) END AS fold FROM fn),
fs AS (SELECT symbol, CAST(fold AS INTEGER) AS fold, {SUMS_OF} FROM ff GROUP BY ALL), ft AS (SELECT symbol, {', '.join(f'sum({c}) AS t{c}' for c in SUM_NAMES)} FROM fs GROUP BY symbol),
fv AS ({' UNION ALL '.join(f"SELECT symbol, '{name}' AS statistic, fold, {value('')} AS a, {value('less')} AS b FROM (SELECT *, {', '.join(f't{c} - {c} AS less{c}' for c in SUM_NAMES)} FROM fs JOIN ft USING (symbol))" for name, value in OWN.items())})"""
    add("cross_validated_statistics", lambda s, d: q(statistics.cross_validated(returns(s, d), own, "r", by, "i", 8), 6), sql("symbol, statistic, fold, round(a, 6) AS inside, round(b, 6) AS outside", folds_of, "fv"))

    first = MOST - 1
    perm, joint = permuted_sql(4, first, SEED), permuted_sql(4, first, SEED, joint=True)
    add("permuted_series", lambda s, d: q(resample.permuted(tables.bars(s, d), 4, SEED, first).select("symbol", "rep", "i", "x"), 6), sql("symbol, rep, i, round(x, 6) AS x", perm, "pm"))
    cuts = (20, 70)
    add("permuted_segments", lambda s, d: q(resample.permuted(tables.bars(s, d), 3, SEED, 0, joint=True, cuts=cuts).select("symbol", "rep", "i", "x"), 6), sql("symbol, rep, i, round(x, 6) AS x", permuted_sql(3, 0, SEED, joint=True, cuts=cuts), "pm"))
    add("permuted_jointly", lambda s, d: q(resample.permuted(tables.bars(s, d), 4, SEED, first, joint=True).select("symbol", "rep", "i", "x"), 6), sql("symbol, rep, i, round(x, 6) AS x", joint, "pm"))
    pb_of = lambda reps: f"""rp AS (SELECT CAST(r AS INTEGER) AS rep FROM range({reps}) g(r)),
sh AS (SELECT symbol, i, lo - lag(x) OVER {O} AS ro, lh - lo AS rh, ll - lo AS rl, x - lo AS rc FROM bars),
ng AS (SELECT symbol, rep, ro, row_number() OVER (PARTITION BY symbol, rep ORDER BY CASE WHEN rep = 0 THEN i ELSE {rng.bits_sql(SEED, 'symbol', 'rep', 'i')} END, i) AS a FROM sh, rp WHERE i >= 1),
dy AS (SELECT symbol, rep, rh, rl, rc, row_number() OVER (PARTITION BY symbol, rep ORDER BY CASE WHEN rep = 0 THEN i ELSE {rng.bits_sql(SEED + 1, 'symbol', 'rep', 'i')} END, i) AS a FROM sh, rp WHERE i >= 1),
bt AS (SELECT n.symbol, n.rep, n.a, rh, rl, rc, b.x + sum(ro + rc) OVER (PARTITION BY n.symbol, n.rep ORDER BY n.a ROWS UNBOUNDED PRECEDING) AS x FROM ng n JOIN dy y ON y.symbol = n.symbol AND y.rep = n.rep AND y.a = n.a JOIN bars b ON b.symbol = n.symbol AND b.i = 0),
al AS (SELECT symbol, rep, i, lo, lh, ll, x FROM bars, rp WHERE i = 0 UNION ALL SELECT symbol, rep, CAST(a AS INTEGER), x - rc, x - rc + rh, x - rc + rl, x FROM bt)"""  # noqa: E731
    pb = pb_of(3)
    add("permuted_bars", lambda s, d: q(resample.permuted_bars(tables.bars(s, d), 3, SEED), 6), sql("symbol, rep, i, round(lo, 6) AS lo, round(lh, 6) AS lh, round(ll, 6) AS ll, round(x, 6) AS x", pb, "al"))
    most = 8
    trend = f"""{permuted_sql(10, most - 1, SEED)}, {grid_sql('pm', 'symbol, rep, ', most, 'sum(ret) AS v, sum(CASE WHEN sg = 1 THEN 1 ELSE 0 END) AS nl, sum(CASE WHEN sg = -1 THEN 1 ELSE 0 END) AS ns')},
tp AS (SELECT * FROM gr QUALIFY row_number() OVER (PARTITION BY symbol, rep ORDER BY round(v, 10) DESC, long, short) = 1),
en AS (SELECT symbol, arg_max(x, i) AS z, max(CASE WHEN i = {most - 1} THEN x END) AS a, count(*) AS n FROM bars GROUP BY symbol),
vt AS (SELECT symbol, rep, v, (nl - ns) * (z - a) / (n - {most}) AS t FROM tp JOIN en USING (symbol))"""
    add("mcpt_trend", lambda s, d: q(resample.mcpt_trend(tables.bars(s, d), most, 10, SEED)), sql(MCPT, trend, f"({BASE})", "GROUP BY symbol"))
    # at the reference's size: 190 pairs, 1,000 replications; beyond what SQL can do with a row a bar
    add("mcpt_trend_1000", lambda s, d: q(resample.mcpt_trend(tables.bars(s, d), 20, 1000, SEED)))
    look = 5
    cell = lambda v, step: f"CAST(greatest(least(floor({v} / {step} + 1e-9), 50), 0) AS INTEGER)"
    on = "(PARTITION BY symbol, rep ORDER BY i)"
    bars_test = f"""{pb_of(6)}, mr AS (SELECT symbol, rep, i, x - lag(x, {look}) OVER {on} AS rise, lag(x) OVER {on} - x AS drp, lead(lo, 2) OVER {on} - lead(lo, 1) OVER {on} AS ret FROM al),
ce AS (SELECT symbol, rep, {cell('rise', 0.005)} AS a, {cell('drp', 0.0005)} AS d, sum(ret) AS s, count(*) AS c FROM mr WHERE rise IS NOT NULL AND ret IS NOT NULL GROUP BY ALL),
gg AS (SELECT symbol, rep, CAST(u AS INTEGER) AS rise, CAST(w AS INTEGER) AS dr, coalesce(sum(s) FILTER (a >= u AND d >= w), 0.0) AS v, coalesce(sum(c) FILTER (a >= u AND d >= w), 0) AS nl FROM ce, range(1, 51) x(u), range(1, 51) y(w) GROUP BY ALL),
tp AS (SELECT * FROM gg QUALIFY row_number() OVER (PARTITION BY symbol, rep ORDER BY round(v, 10) DESC, rise, dr) = 1),
en AS (SELECT symbol, arg_max(lo, i) AS z, max(CASE WHEN i = {look + 1} THEN lo END) AS a, count(*) AS n FROM bars GROUP BY symbol),
vt AS (SELECT symbol, rep, v, nl * (z - a) / (n - {look} - 2) AS t FROM tp JOIN en USING (symbol))"""
    add("mcpt_bars", lambda s, d: q(resample.mcpt_bars(tables.bars(s, d), look, 6, SEED)), sql(MCPT, bars_test, f"({BASE})", "GROUP BY symbol"))

    m, blocks = 8, 6
    cs = cscv_sql(m, blocks)
    add("cscv", lambda s, d: q(resample.cscv(grids.crossover_returns(tables.bars(s, d), "x", m), blocks, m - 1)), sql(CSCV, cs, "rk", "GROUP BY symbol"))
    sb = f"""{rows_sql(m)}, tt AS (SELECT symbol, short, long, sum(ret) AS t FROM rows2 GROUP BY 1, 2, 3),
rs AS (SELECT r.symbol, r.i, r.ret, r.short, r.long, t - ret AS rest FROM rows2 r JOIN tt USING (symbol, short, long)),
bs AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol, i ORDER BY rest DESC, long, short) AS k FROM rs) WHERE k = 1)"""
    add(
        "stochastic_bias",
        lambda s, d: q(resample.stochastic_bias(grids.crossover_returns(tables.bars(s, d), "x", m), ["symbol"]), 5),
        sql("symbol, round(sum(rest) / (count(*) - 1), 5) AS is_sum, round(sum(ret), 5) AS oos_sum, round(sum(rest) / (count(*) - 1) - sum(ret), 5) AS bias", sb, "bs", "GROUP BY symbol"),
    )
    dd_reps, size = 40, 60
    dd = f"{RET}, {draws_sql('dr', 'ret', 'symbol, ', dd_reps, SEED, str(size))}, pa AS (SELECT symbol, rep, j, r FROM dr JOIN ret USING (symbol, i)), {drawdowns_sql('pa', 'symbol, rep, ', 'r')}"
    add(
        "drawdown_quantiles",
        lambda s, d: q(resample.drawdown_quantiles(returns(s, d), "r", by, size, dd_reps, SEED, DD)),
        sql("symbol, prob, round(drawdown, 6) AS drawdown", f"{dd}, o AS (" + " UNION ALL ".join(f"SELECT symbol, {p}::DOUBLE AS prob, {quantile_sql('dd', str(p))} AS drawdown FROM w GROUP BY symbol" for p in DD) + ")", "o"),
    )
    add(
        "random_variates",
        lambda s, d: q(s.range(500).select("id", rng.uniform(3, "id").alias("u"), rng.normal(5, "id").alias("z"))),
        f"SELECT id, round({rng.uniform_sql(3, 'id')}, 6) AS u, round({rng.normal_sql(5, 'id')}, 6) AS z FROM range(500) t(id)",
    )
    u, z = (lambda k: rng.uniform_sql(k, "id")), (lambda k: rng.normal_sql(k, "id"))
    gamma = lambda seed, shape: "(" + " + ".join(f"-ln({u(seed + 2 * k)})" for k in range(shape)) + ")"
    length = f"sqrt(pow({z(9)}, 2) + pow({z(19)}, 2) + pow({z(29)}, 2))"
    add(
        "more_variates",
        lambda s, d: q(
            s.range(500).select(
                "id", rng.cauchy(3, "id").alias("cauchy"), rng.gamma_whole(5, 3, "id").alias("gamma"), rng.beta_whole(7, 2, 3, "id").alias("beta"), *[rng.sphere(9, 3, "id")[k].alias(f"sphere{k}") for k in range(3)]
            ), 5,
        ),
        f"SELECT id, round(tan(3.141592653589793 * ({u(3)} - 0.5)), 5) AS cauchy, round({gamma(5, 3)}, 5) AS gamma, round({gamma(7, 2)} / ({gamma(7, 2)} + {gamma(1007, 3)}), 5) AS beta, " + ", ".join(f"round({z(9 + 10 * k)} / {length}, 5) AS sphere{k}" for k in range(3)) + " FROM range(500) t(id)",
    )
    shapes = (1, 3, 5, 40)
    add(
        "order_variates",
        lambda s, d: q(tables.spread(tables.table(s, d, "orders").select("o_orderkey"), "o_orderkey").select("o_orderkey", *[rng.gamma_half(11, v, "o_orderkey").alias(f"gamma{v}") for v in shapes], rng.beta_half(13, 3, 5, "o_orderkey").alias("beta3_5")), 5),
        "SELECT o_orderkey, " + ", ".join(f"round({rng.gamma_half_sql(11, v, 'o_orderkey')}, 5) AS gamma{v}" for v in shapes) + f", round({rng.beta_half_sql(13, 3, 5, 'o_orderkey')}, 5) AS beta3_5 FROM orders",
    )
