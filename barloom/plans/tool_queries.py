"""Models, optimizers, streaming and the tools built from them."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from ..functions import dist, rng
from ..operators import backtest, grids, indicators as ind, market_models, optimize
from ..sources import exchange, tables
from ..sources.scratch import shared_folder
from ..streaming import bars as minute, trade_log
from . import catalog, tail_sql, tools
from .grid_queries import ALIGNED, breakout_folds_sql, chooser_sql, crossover_folds_sql, kind_sql
from .indicator_queries import TR, atr_sql, expansion_sql, full, jump_sql, slope_sql, sql, w
from .resample_queries import CSCV, LEVELS, PICK, accel_sql, bca_sql, cscv_sql, draws_sql, drawdowns_sql, grid_sql, mean_theta_sql, permuted_sql, quantile_sql, sorted_sql

TICKS = "SELECT event_type AS symbol, ts, event_id, value FROM events"


SEGMENTS = 12
#: One trade in so many reaches the recorder so many segments late.
DELAYED, DELAY = 97, 3


def recorded(ticks, segments: int = SEGMENTS, delayed: int = 0):
    """Trades as ``channel, segment, value`` in the order of time; one in ``delayed`` stands some segments later. The last segment has the row that closes the replay."""
    ends = ticks.agg(F.min("ts").alias("_a"), F.max("ts").alias("_b"))
    share = (F.unix_micros("ts") - F.unix_micros("_a")) / (F.unix_micros("_b") - F.unix_micros("_a") + 1)
    place = F.floor(share * segments)
    late = F.when(F.col("seq") % delayed == 0, DELAY).otherwise(0) if delayed else F.lit(0)
    rows = ticks.join(F.broadcast(ends), F.lit(True)).withColumn("segment", F.least(place + late, F.lit(segments - 1)).cast("int"))
    last = minute.closed(ticks).where(F.col("symbol") == minute.END).withColumn("segment", F.lit(segments).cast("int"))
    both = trade_log.messages(rows.select(*ticks.columns, "segment").unionByName(last))
    return both.select(F.lit("spot").alias("channel"), F.format_string("%05d", "segment").alias("segment"), "value")


def own_session(spark):
    """A session whose streams keep their state in as many partitions as there are cores, not in as many as large batches take."""
    made = spark.newSession()
    few = min(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    made.conf.set("spark.sql.shuffle.partitions", max(1, few))
    made.conf.set("spark.sql.session.timeZone", spark.conf.get("spark.sql.session.timeZone"))
    return made


BAR_COLUMNS = "ts timestamp, open double, high double, low double, close double, volume double, n long, symbol string"


def run_stream(spark, home: str, steps, rows, segments: int = 1) -> dict[str, int]:
    """Bars of the log in ``home`` while it grows: ``rows(step)`` is appended at each step, and the stream is stopped and started again at each.

    Gives how many batches ran. Bars are in ``home/bars``, trades in ``home/log``.
    """
    streams = own_session(spark)
    for step in steps:
        trade_log.record(rows(step), f"{home}/log")
        ticks = minute.parse_trades(trade_log.read_log(streams, f"{home}/log", segments=segments, progress=f"{home}/progress"))
        query = minute.write_bars(minute.minute_bars(ticks, late="2 hours", counted=True), f"{home}/bars", f"{home}/checkpoint", once=False)
        try:
            query.processAllAvailable()
        finally:
            query.stop()
    fs, path = trade_log.located(home)
    done = fs.get_file_info(trade_log.pa_fs.FileSelector(f"{path}/checkpoint/commits"))
    return {"batches": sum(not i.base_name.startswith(".") for i in done)}


def stream_query(spark, sf_dir):
    """The recorded trades as a stream in many batches, stopped and started again half-way, the rest recorded meanwhile: every minute of every symbol, once."""
    home = shared_folder(spark)
    ticks = tables.ticks(spark, sf_dir)
    rows = written_log(recorded(ticks), home)
    half = f"{SEGMENTS // 2:05d}"
    run_stream(spark, home, (0, 1), lambda k: rows.where((F.col("segment") < half) if k == 0 else (F.col("segment") >= half)))
    return spark.read.schema(BAR_COLUMNS).parquet(f"{home}/bars").select("symbol", F.date_format("ts", "yyyyMMdd HH:mm").alias("minute"), "open", "high", "low", "close", "volume")


def written_log(rows, home: str):
    """The recorded rows as a table, of which a step reads its own segments alone."""
    rows.write.partitionBy("segment").parquet(f"{home}/recorded")
    return rows.sparkSession.read.schema("channel string, value string, segment string").parquet(f"{home}/recorded")


def late_query(spark, sf_dir):
    """The stream over trades of which some arrive late, a restart a segment: how many each bar holds and how many came too late for it."""
    home = shared_folder(spark)
    ticks = tables.ticks(spark, sf_dir)
    rows = written_log(recorded(ticks, delayed=DELAYED), home)
    run_stream(spark, home, range(SEGMENTS + 1), lambda k: rows.where(F.col("segment") == f"{k:05d}"))
    bars = spark.read.schema(BAR_COLUMNS).parquet(f"{home}/bars")
    stored = minute.parse_trades(spark.read.text(f"{home}/log")).where(F.col("symbol") != minute.END)
    return minute.late_trades(stored, bars).select("symbol", F.date_format("ts", "yyyyMMdd HH:mm").alias("minute"), "kept", "late")


def kline_query(spark, sf_dir):
    """Daily bars through the exchange's pages: recorded pages overlap, the archive holds their bars twice, the paged source gives each once."""
    path = f"{shared_folder(spark)}/klines"
    bars = tables.daily_bars(spark, sf_dir)
    held = bars.select("symbol", (F.unix_date("dt").cast("long") * DAY).alias("ts"), "open", "high", "low", "close", "volume")
    again = held.where(F.pmod(F.floor(F.col("ts") / DAY), F.lit(50)) < 3)  # the end of one page and the start of the next
    exchange.archive(held.unionByName(again), path, block=100)
    exchange.register(spark)
    read = spark.read.format("klines").options(path=path, limit="200").load()
    return read.select("symbol", F.date_format(F.timestamp_millis("ts"), "yyyyMMdd").alias("day"), "open", "high", "low", "close", "volume")


DAY = 86_400_000


def late_sql() -> str:
    place = f"CAST(floor((epoch_us(ts) - a) / (b - a + 1) * {SEGMENTS}) AS INTEGER)"
    return f"""WITH e AS (SELECT event_type AS symbol, ts, event_id, min(epoch_us(ts)) OVER () AS a, max(epoch_us(ts)) OVER () AS b FROM events),
p AS (SELECT symbol, ts, least({place} + CASE WHEN event_id % {DELAYED} = 0 THEN {DELAY} ELSE 0 END, {SEGMENTS - 1}) AS segment FROM e),
s AS (SELECT segment, max(max(ts)) OVER (ORDER BY segment ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - INTERVAL 2 HOUR AS mark FROM p GROUP BY segment),
m AS (SELECT symbol, date_trunc('minute', ts) AS minute, coalesce(date_trunc('minute', ts) + INTERVAL 1 MINUTE <= date_trunc('millisecond', mark), false) AS late FROM p JOIN s USING (segment))
SELECT symbol, strftime(minute, '%Y%m%d %H:%M') AS minute, count(*) FILTER (NOT late) AS kept, count(*) FILTER (late) AS late FROM m GROUP BY symbol, m.minute HAVING count(*) FILTER (late) > 0"""


def entropy_sql(n: int, bins: int) -> str:
    held = f"""{TR}, v AS (SELECT symbol, i, {slope_sql(n)} AS trend, {atr_sql(n)} AS volatility, {expansion_sql(n)} AS expansion, {jump_sql(n)} AS raw_jump FROM t),
h AS (SELECT * FROM v WHERE trend IS NOT NULL AND volatility IS NOT NULL AND expansion IS NOT NULL AND raw_jump IS NOT NULL),
n AS (SELECT symbol, i, raw_jump AS v, row_number() OVER (PARTITION BY symbol ORDER BY raw_jump) AS r, greatest(CAST(floor(count(*) OVER (PARTITION BY symbol) * (1 - 2 * 0.05)) AS INTEGER) - 1, 0) AS sp FROM h),
c AS (SELECT a.symbol, a.v AS lo, b.v AS hi, row_number() OVER (PARTITION BY a.symbol ORDER BY b.v - a.v, a.r) AS k FROM n a JOIN n b ON b.symbol = a.symbol AND b.r = a.r + a.sp),
e AS (SELECT symbol, lo, hi, greatest(hi - lo, 1e-30) AS w FROM c WHERE k = 1),
lg AS (SELECT symbol, series, value FROM (SELECT symbol, trend, volatility, expansion, raw_jump FROM h) UNPIVOT (value FOR series IN (trend, volatility, expansion, raw_jump))
  UNION ALL SELECT n.symbol, 'cleaned_jump', CASE WHEN v < lo THEN lo - 0.1 * w * (1 - exp(-(lo - v) / w)) WHEN v > hi THEN hi + 0.1 * w * (1 - exp(-(v - hi) / w)) ELSE v END FROM n JOIN e USING (symbol)),
q AS (SELECT symbol, series, min(value) AS low, max(value) AS high, quantile_cont(value, 0.5) AS median, count(*) AS n FROM lg GROUP BY ALL),
b AS (SELECT symbol, series, floor(({bins} - 1e-10) / (any_value(high) - any_value(low) + 1e-60) * (value - any_value(low))) AS b, CAST(count(*) AS DOUBLE) AS c, any_value(n) AS n FROM lg JOIN q USING (symbol, series) GROUP BY symbol, series, value),
b2 AS (SELECT symbol, series, b, sum(c) AS c, any_value(n) AS n FROM b GROUP BY ALL),
z AS (SELECT symbol, series, -sum(c / n * ln(c / n)) / ln({float(bins)}) AS entropy FROM b2 GROUP BY symbol, series)"""
    return sql("symbol, series, round(low, 6) AS low, round(high, 6) AS high, round(median, 6) AS median, round(entropy, 6) AS entropy", held, "q JOIN z USING (symbol, series)").replace("SELECT symbol, series, b, sum(c) AS c, any_value(n) AS n FROM b GROUP BY ALL", "SELECT symbol, series, b, sum(c) AS c, any_value(n) AS n FROM b GROUP BY symbol, series, b")


def stationarity_sql(n: int, fractile: float) -> str:
    run = "(PARTITION BY symbol, series ORDER BY i)"
    held = f"""{TR}, v AS (SELECT symbol, i, {slope_sql(n)} AS trend, {atr_sql(n)} AS volatility FROM t),
lg AS (SELECT symbol, i, series, value FROM v UNPIVOT (value FOR series IN (trend, volatility))),
q AS (SELECT symbol, series, {quantile_sql('value', str(fractile))} AS cut FROM lg GROUP BY symbol, series),
a AS (SELECT symbol, series, i, value >= cut AS above FROM lg JOIN q USING (symbol, series)),
f AS (SELECT *, CASE WHEN lag(above) OVER {run} IS NULL OR above <> lag(above) OVER {run} THEN 1 ELSE 0 END AS nw FROM a),
g AS (SELECT *, sum(nw) OVER (PARTITION BY symbol, series ORDER BY i ROWS UNBOUNDED PRECEDING) AS run FROM f), l AS (SELECT symbol, series, above, run, count(*) AS len FROM g GROUP BY ALL)"""
    return sql("symbol, above, CAST(CASE WHEN len > 512 THEN 1024 ELSE pow(2, ceil(log2(len))) END AS INTEGER) AS bucket, count(*) AS n, series", held, "l", "GROUP BY ALL")


def walk_sql(name: str, reps: int, n: int, trend: float, seed: int, phase: int = 0) -> str:
    u = [rng.uniform_sql(seed + k, "r", "j") for k in range(4)]
    step = f"CASE WHEN j = 0 THEN 0.0 ELSE CASE WHEN ((j + {phase}) // 50) % 2 = 0 THEN {trend!r} ELSE {-trend!r} END + {u[0]} + {u[1]} - {u[2]} - {u[3]} END"
    return f"{name} AS (SELECT CAST(r AS INTEGER) AS rep, CAST(j AS INTEGER) AS i, sum({step}) OVER (PARTITION BY r ORDER BY j ROWS UNBOUNDED PRECEDING) AS x FROM range({reps}) a(r), range({n}) b(j))"


def scores_sql(side: int = 0) -> str:
    """mean, profit_factor and sharpe of a crossover's bars, or of those with one position."""
    r = "ret" if not side else f"(CASE WHEN sg = {side} THEN ret ELSE 0.0 END)"
    n = "count(*)" if not side else f"(sum(CASE WHEN sg = {side} THEN 1 ELSE 0 END) + 1e-30)"
    mean = f"(sum({r}) / {n})"
    var = f"(sum({r} * {r}) / {n} - {mean} * {mean})"
    sharpe = f"{mean} / (sqrt(greatest({var}, 0.0)) + 1e-8)" if not side else f"{mean} / sqrt(greatest({var}, 1e-20))"
    return f"{mean} AS mean, (sum(greatest({r}, 0.0)) + 1e-60) / (sum(greatest(-{r}, 0.0)) + 1e-60) AS profit_factor, {sharpe} AS sharpe"


def top_sql(name: str, source: str, criterion: str) -> str:
    return f"{name} AS (SELECT * FROM {source} QUALIFY row_number() OVER (PARTITION BY rep ORDER BY round({criterion}, 10) DESC, long, short) = 1)"


def training_sql(criterion: str, reps: int = 10, n: int = 200, most: int = 10, seed: int = 41) -> str:
    ctes = [walk_sql("wa", reps, n, 0.0, seed), walk_sql("wb", reps, n, 0.0, seed + 500), grid_sql("wa", "rep, ", most, scores_sql(), True, "ga"), grid_sql("wb", "rep, ", most, scores_sql(), True, "gb"), top_sql("tp", "ga", criterion)]
    return f"WITH {', '.join(ctes)} SELECT rep, short, long, round(tp.mean, 6) AS in_sample, round(gb.mean, 6) AS out_of_sample, round(tp.mean - gb.mean, 6) AS bias FROM tp JOIN gb USING (rep, short, long)"


def selection_sql(criterion: str, reps: int = 10, n: int = 200, most: int = 10, seed: int = 61, trend: float = 0.05) -> str:
    ctes = [walk_sql(f"w{k}", reps, n, trend, seed + more, 1) for k, more in enumerate((0, 500, 900))]
    for side, name in ((1, "long"), (-1, "short")):
        ctes += [grid_sql(f"w{k}", "rep, ", most, scores_sql(side), True, f"g{name}{k}") for k in range(3)] + [top_sql(f"t{name}", f"g{name}0", criterion)]
        ctes.append(f"s{name} AS (SELECT rep, t.mean AS m0, a.mean AS m1, b.mean AS m2 FROM t{name} t JOIN g{name}1 a USING (rep, short, long) JOIN g{name}2 b USING (rep, short, long))")
    pick = lambda k: f"CASE WHEN l.m1 > s.m1 THEN l.m{k} ELSE s.m{k} END"
    return f"WITH {', '.join(ctes)} SELECT rep, round(l.m0 - l.m1, 6) AS long_bias, round(s.m0 - s.m1, 6) AS short_bias, CASE WHEN l.m1 > s.m1 THEN 'long' ELSE 'short' END AS side, round({pick(1)}, 6) AS oos1, round({pick(2)}, 6) AS oos2, round({pick(1)} - {pick(2)}, 6) AS bias FROM slong l JOIN sshort s USING (rep)"


def cases_sql(source: str, lookback: int, ahead: int) -> str:
    by = "(PARTITION BY rep ORDER BY i"
    return f"ca AS (SELECT rep, i - {lookback - 1} AS k, a, b FROM (SELECT rep, i, regr_slope(x, CAST(i AS DOUBLE)) OVER {by} ROWS BETWEEN {lookback - 1} PRECEDING AND CURRENT ROW) * {(lookback - 1) / 2!r} AS a, lead(x, {ahead}) OVER {by}) - x AS b FROM {source}) WHERE i >= {lookback - 1} AND b IS NOT NULL)"


def fitted_sql(name: str, table: list[tuple], inside: str, tested: str) -> str:
    """``name``: rep, r of the cases that are ``tested`` by regressions on those ``inside``, for rows (fold, u, v, w) of a table."""
    rows = ", ".join(str((*t, 0)[:4]) for t in table)
    beta = "(covar_pop(b, a) * count(*) / (var_pop(a) * count(*) + 1e-60))"
    return f"""{name}_t(fold, u, v, w) AS (VALUES {rows}), {name}_f AS (SELECT rep, fold, {beta} AS beta, avg(b) - {beta} * avg(a) AS c FROM ca JOIN {name}_t ON {inside} GROUP BY rep, fold),
{name} AS (SELECT rep, CASE WHEN a * beta + c > 0 THEN b ELSE -b END AS r FROM ca JOIN {name}_t ON {tested} JOIN {name}_f USING (rep, fold))"""


def overlap_sql(reps: int = 9, n: int = 600, lookback: int = 20, ahead: int = 10, n_train: int = 100, n_test: int = 20, seed: int = 71) -> str:
    table = grids.folds(n - lookback - ahead + 1, n_train, n_test)
    ctes = [walk_sql("wa", reps, n, 0.0, seed), cases_sql("wa", lookback, ahead), fitted_sql("wk", table, "k >= u AND k < v", "k >= v AND k < w")]
    ctes.append("ms AS (SELECT rep, count(*) AS n, avg(r) AS m, sqrt(greatest(var_pop(r), 1e-20)) AS sd FROM wk GROUP BY rep), ts AS (SELECT *, sqrt(n) * m / sd AS t FROM ms)")
    ctes.append(f"ps AS (SELECT *, 1 - {dist.normal_cdf_sql('t')} AS p FROM ts), al AS (SELECT list_sort(list(t))[{reps // 2 + 1}] AS md, avg(CASE WHEN p <= 0.1 THEN 1.0 ELSE 0.0 END) AS sh FROM ps)")
    return f"WITH {', '.join(ctes)} SELECT rep, n, round(m, 6) AS mean, round(sd, 6) AS sd, round(t, 6) AS t, round(p, 6) AS p, round(md, 6) AS median_t, round(sh, 6) AS share FROM ps, al"


def validation_sql(reps: int = 5, n: int = 400, lookback: int = 20, ahead: int = 5, folds: int = 5, omit: int = 5, n_train: int = 100, n_test: int = 50, seed: int = 81) -> str:
    size = n - lookback - ahead + 1
    ctes = [walk_sql("wa", reps, n, 0.0, seed, 1), cases_sql("wa", lookback, ahead)]
    ctes.append(fitted_sql("wk", grids.folds(size, n_train, n_test), f"k >= u AND k < v - {omit}", "k >= v AND k < w"))
    ctes.append(fitted_sql("xv", tools.even_cuts(size, folds), f"(k < u - {omit} OR k >= v + {omit})", "k >= u AND k < v"))
    part = "SELECT rep, '{0}' AS method, count(*) AS n, round(avg(r), 6) AS mean FROM {1} GROUP BY rep"
    return f"WITH {', '.join(ctes)} {part.format('walk', 'wk')} UNION ALL {part.format('xval', 'xv')}"


def order_sql(samples: int = 100, rate: float = 0.1, low_q: float = 0.0975, high_q: float = 0.101, tries: int = 400, seed: int = 31) -> str:
    m = max(1, int(rate * (samples + 1)))
    return f"""WITH u AS (SELECT r, {rng.uniform_sql(seed, 'r', 'j')} AS u FROM range({tries}) a(r), range({samples}) b(j)), b AS (SELECT r, list_sort(list(u))[{m}] AS b FROM u GROUP BY r)
SELECT round(avg(CASE WHEN b < {low_q} THEN 1.0 ELSE 0.0 END), 6) AS below_low, round(avg(CASE WHEN b > {high_q} THEN 1.0 ELSE 0.0 END), 6) AS above_high, round(avg(b), 6) AS mean_rate,
round({tail_sql.order_tail(f'{samples}.0', repr(low_q), f'{m}.0')}, 6) AS theory_low, round(1 - {tail_sql.order_tail(f'{samples}.0', repr(high_q), f'{m}.0')}, 6) AS theory_high FROM b"""


def coverage_sql(samples: int = 30, reps: int = 50, tries: int = 40, prob: float = 0.6, seed: int = 9) -> str:
    size = f"({rng.normal_sql(seed + 3, 't', 'i')} * 0.002 + 0.01)"
    stats = {
        "log_pf": "ln((sum(greatest(r, 0.0)) + 1e-10) / (sum(greatest(-r, 0.0)) + 1e-10))",
        "sharpe": "(CASE WHEN stddev_pop(r) > 0 THEN avg(r) / stddev_pop(r) ELSE 1e30 END)",
    }
    truth = {"log_pf": f"{math.log(prob / (1 - prob))!r}", "sharpe": f"(SELECT {stats['sharpe']} FROM da)"}
    head = f"da AS (SELECT CAST(t AS BIGINT) AS t, CAST(i AS INTEGER) AS i, CASE WHEN {rng.uniform_sql(seed, 't', 'i')} <= {prob} THEN {size} ELSE -{size} END AS r FROM range({tries}) a(t), range({samples}) b(i)), "
    head += f"dr AS (SELECT t, rep, r FROM (SELECT CAST(t AS BIGINT) AS t, rep, CAST({rng.bits_sql(seed + 7, 't', 'rep', 'j')} % {samples} AS INTEGER) AS i FROM range({tries}) a(t), range({reps}) b(rep), range({samples}) c(j)) JOIN da USING (t, i)), lo1 AS (SELECT a.t, a.i AS o, b.r FROM da a JOIN da b ON b.t = a.t AND b.i <> a.i), {LEVELS}"
    out = []
    for name, stat in stats.items():
        own = f"""st AS (SELECT t AS try, rep, {stat} AS stat FROM dr GROUP BY t, rep), so AS (SELECT try, list_sort(list(stat)) AS s, count(*) AS b FROM st GROUP BY try),
jk AS (SELECT t AS try, o, {stat} AS j FROM lo1 GROUP BY t, o), jm AS (SELECT try, avg(j) AS jm FROM jk GROUP BY try), ja AS (SELECT try, {accel_sql('jm - j')} AS a FROM jk JOIN jm USING (try) GROUP BY try),
th AS (SELECT try, e.t, a FROM (SELECT t AS try, {stat} AS t FROM da GROUP BY da.t) e JOIN ja USING (try)), {bca_sql('try, ')},
pc AS (SELECT try, prob, s[{PICK}] AS lo, s[b + 1 - {PICK}] AS hi, t FROM so JOIN th USING (try), lv),
al AS (SELECT 'percentile' AS method, prob, lo, hi FROM pc UNION ALL SELECT 'pivot', prob, 2 * t - hi, 2 * t - lo FROM pc UNION ALL SELECT 'bca', prob, lo, hi FROM bc)"""
        out.append(f"SELECT * FROM (WITH {head}, {own} SELECT '{name}' AS statistic, method, prob AS level, round(avg(CASE WHEN lo > {truth[name]} THEN 1.0 ELSE 0.0 END), 6) AS low, round(avg(CASE WHEN hi < {truth[name]} THEN 1.0 ELSE 0.0 END), 6) AS high FROM al GROUP BY method, prob)")
    return " UNION ALL ".join(out)


def drawdown_sql(n_changes: int = 40, n_trades: int = 20, win: float = 0.6, reps: int = 20, inner: int = 20, tests: int = 10, paths: int = 50, conf: float = 0.8, seed: int = 21) -> str:
    signed = lambda seed, *k: f"(CASE WHEN {rng.uniform_sql(seed, *k)} < {win} THEN 1.0 ELSE -1.0 END * abs({rng.normal_sql(seed + 2, *k)}))"
    over = lambda **k: ", ".join(f"range({n}) x{a}({a})" for a, n in k.items())
    pick = lambda seed, *k: f"CAST({rng.bits_sql(seed, *k)} % {n_changes} AS INTEGER)"
    levels = [1 - (1 - conf) / 2, 1 - (1 - conf) / 2, conf, conf]
    ctes = [
        f"sa AS (SELECT t, CAST(i AS INTEGER) AS i, {signed(seed, 't', 'i')} AS r FROM {over(t=tests, i=n_changes)})",
        f"oc AS (SELECT t, rep, j, r FROM (SELECT t, rep, j, {pick(seed + 5, 't', 'rep', 'j')} AS i FROM {over(t=tests, rep=reps, j=n_trades)}) JOIN sa USING (t, i))",
        "me AS (SELECT t, " + ", ".join(f"{quantile_sql('m', repr(p))} AS m{k}" for k, p in enumerate(tools.RATES)) + " FROM (SELECT t, rep, avg(r) AS m FROM oc GROUP BY t, rep) GROUP BY t)",
        drawdowns_sql("oc", "t, rep, ", "r", "wf"),
        "fa AS (SELECT t, " + ", ".join(f"{quantile_sql('dd', repr(1 - p))} AS d{k}" for k, p in enumerate(tools.RATES)) + " FROM wf GROUP BY t)",
        f"ag AS (SELECT t, rep, j AS i, r FROM (SELECT t, rep, CAST(j AS INTEGER) AS j, {pick(seed + 6, 't', 'rep', 'j')} AS i FROM {over(t=tests, rep=reps, j=n_changes)}) JOIN sa USING (t, i))",
        f"ne AS (SELECT t, rep, b, j, r FROM (SELECT t, rep, b, j, {pick(seed + 7, 't', 'rep', 'b', 'j')} AS i FROM {over(t=tests, rep=reps, b=inner, j=n_trades)}) JOIN ag USING (t, rep, i))",
        drawdowns_sql("ne", "t, rep, b, ", "r", "wn"),
        "iq AS (SELECT t, rep, " + ", ".join(f"{quantile_sql('dd', repr(1 - p))} AS q{k}" for k, p in enumerate(tools.RATES)) + " FROM wn GROUP BY t, rep)",
        "ou AS (SELECT t, " + ", ".join(f"{quantile_sql(f'q{k}', repr(p))} AS b{k}" for k, p in enumerate(levels)) + " FROM iq GROUP BY t)",
        f"fr AS (SELECT t, path, j, {signed(seed + 8, 't', 'path', 'j')} AS r FROM {over(t=tests, path=paths, j=n_trades)})",
        drawdowns_sql("fr", "t, path, ", "r", "ws"),
        "se AS (SELECT * FROM ws JOIN (SELECT t, path, avg(r) AS mean FROM fr GROUP BY t, path) USING (t, path) JOIN me USING (t) JOIN fa USING (t) JOIN ou USING (t))",
    ]
    share = lambda c: f"round(avg(CASE WHEN {c} THEN 1.0 ELSE 0.0 END), 6)"
    return f"WITH {', '.join(ctes)} " + " UNION ALL ".join(f"SELECT {p}::DOUBLE AS rate, {share(f'mean < m{k}')} AS mean_worse, {share(f'dd > d{k}')} AS drawdown_worse, {share(f'dd > b{k}')} AS bounded_worse FROM se" for k, p in enumerate(tools.RATES))


def chooser_report_sql(window: int, out_window: int, reps: int, seed: int = 93) -> str:
    name = "['total', 'sharpe', 'profit_factor'][criterion + 1]"
    ctes = f"""{ALIGNED}, {permuted_sql(reps, 0, seed, 'al', True, (window, window + out_window))}, {chooser_sql(window, out_window, 'pm', 'rep, ')},
ma AS (SELECT rep, {name} AS criterion, avg(nx) * 25200 AS v FROM p WHERE i >= {window + out_window - 1} GROUP BY ALL UNION ALL SELECT rep, 'final', avg(nx) * 25200 FROM z WHERE kk = 1 GROUP BY rep),
pv AS (SELECT a.criterion, b.v AS v0, avg(CASE WHEN round(a.v, 9) >= round(b.v, 9) THEN 1.0 ELSE 0.0 END) AS p FROM ma a JOIN ma b ON b.criterion = a.criterion AND b.rep = 0 GROUP BY ALL),
ch AS (SELECT {name} AS criterion, count(*) / (SELECT count(*) FROM z WHERE kk = 1 AND rep = 0) AS c FROM z WHERE kk = 1 AND rep = 0 GROUP BY ALL)"""
    return sql("criterion, round(v0, 6) AS mean_x25200, round(p, 6) AS p, CASE WHEN criterion <> 'final' THEN round(coalesce(c, 0.0), 6) END AS chosen", ctes, "pv LEFT JOIN ch USING (criterion)")


def chooser_bounds_sql(window: int, out_window: int, reps: int = 20, inner: int = 20, size: int = 40, seed: int = 91) -> str:
    probs = (0.999, 0.99, 0.95, 0.90)
    ctes = f"""{ALIGNED}, {chooser_sql(window, out_window)}, he AS (SELECT 1 AS one, nx AS r, CAST(row_number() OVER (ORDER BY i) - 1 AS INTEGER) AS i FROM z WHERE kk = 1), {draws_sql('dr', 'he', 'one, ', reps, seed)},
sa AS (SELECT rep, j AS i, r FROM dr JOIN he USING (one, i)),
pa AS (SELECT rep, b, j, r FROM (SELECT CAST(rep AS INTEGER) AS rep, CAST(b AS INTEGER) AS b, CAST(j AS INTEGER) AS j, CAST({rng.bits_sql(seed + 1, 'rep', 'b', 'j')} % (SELECT count(*) FROM he) AS INTEGER) AS i FROM range({reps}) x(rep), range({inner}) y(b), range({size}) w(j)) JOIN sa USING (rep, i)),
{drawdowns_sql('pa', 'rep, b, ', 'r', 'wd')}, pc AS (SELECT rep, (1 - exp(-dd)) * 100 AS dd FROM wd),
ea AS ({' UNION ALL '.join(f"SELECT rep, {p}::DOUBLE AS prob, {quantile_sql('dd', repr(p))} AS q FROM pc GROUP BY rep" for p in probs)}),
fo AS ({' UNION ALL '.join(f"SELECT prob, {c}::DOUBLE AS confidence, {quantile_sql('q', repr(c))} AS bound FROM ea GROUP BY prob" for c in tools.CONFIDENCES)})"""
    return sql("prob, confidence, round(bound, 6) AS bound", ctes, "fo")


def register(add) -> None:
    q = catalog.rounded
    bars = tables.bars
    minutes = "SELECT event_type AS symbol, strftime(date_trunc('minute', ts), '%Y%m%d %H:%M') AS minute, arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, (ts, event_id)) AS close, CAST(count(*) AS DOUBLE) AS volume FROM events GROUP BY 1, 2"
    add("tick_bars", lambda s, d: minute.minute_bars(tables.ticks(s, d)).select("symbol", F.date_format("ts", "yyyyMMdd HH:mm").alias("minute"), "open", "high", "low", "close", "volume"), minutes)
    add("streamed_bars", stream_query, minutes)
    add("late_trades", late_query, late_sql())
    add("paged_klines", kline_query, sql("symbol, strftime(dt, '%Y%m%d') AS day, open, high, low, close, volume", "one AS (SELECT 1)", "bars0"))
    add("entropy_report", lambda s, d: q(tools.entropy_report(bars(s, d))), entropy_sql(10, 10))
    add("stationarity_report", lambda s, d: tools.stationarity_report(bars(s, d)), stationarity_sql(10, 0.5))
    best = "bc AS (SELECT symbol, max(v) * 1000 AS b FROM (SELECT symbol, avg(ret) AS v FROM rows2 GROUP BY symbol, short, long) GROUP BY symbol), pr AS (SELECT " + CSCV + " FROM rk GROUP BY symbol)"
    add("selection_report", lambda s, d: q(tools.selection_report(bars(s, d), 6, 8)), sql("symbol, n_splits, probability, round(b, 6) AS best_x1000", f"{cscv_sql(8, 6)}, {best}", "pr JOIN bc USING (symbol)"))
    most, steps, n_train, n_test = 8, 4, 120, 60
    folds = dict(most=most, n_train=n_train, n_test=n_test, steps=steps)

    def performance_sql(name: str, kind: int) -> str:
        r = f"pf AS ({kind_sql(kind)})"
        mean = "(sum(ret) / (count(*) + 1e-30))"
        select = f"symbol, '{name}' AS criterion, {kind} AS kind, count(*) AS n, round({mean} * 25200, 6) AS mean_x25200, round((sum(greatest(ret, 0.0)) + 1e-60) / (sum(greatest(-ret, 0.0)) + 1e-60), 6) AS profit_factor, round({mean} / sqrt(greatest(sum(ret * ret) / (count(*) + 1e-30) - {mean} * {mean}, 1e-20)), 6) AS sharpe"
        return sql(select, f"{breakout_folds_sql(most, steps, n_train, n_test, name)}, {r}", "pf", "GROUP BY symbol")

    add("breakout_performance", lambda s, d: q(tools.performance_report(bars(s, d), **folds)), " UNION ALL ".join(f"(SELECT * FROM ({performance_sql(c, k)}))" for c in grids.CRITERIA for k in (1, 2)))
    all_bars = f"{breakout_folds_sql(most, steps, n_train, n_test, 'profit_factor', 'true')}, pf AS ({kind_sql(0)})"
    add("breakout_folds_all_bars", lambda s, d: q(tools.walk_forward_breakout(bars(s, d), kind=0, criterion="profit_factor", all_bars=True, **folds), 8), sql("symbol, fold, i, round(ret, 8) AS ret", all_bars, "pf"))

    keys = "symbol, kind, "
    inverse_t = tail_sql.inverse(lambda x: tail_sql.t_cdf("n - 1.0", x), "0.9", "-10", "10")
    kinds = f"""{breakout_folds_sql(most, steps, n_train, n_test)}, k0 AS ({kind_sql(0)}), k1 AS ({kind_sql(1)}), k2 AS ({kind_sql(2)}),
k3 AS (SELECT symbol, 0 AS fold, g AS i, avg(ret) AS ret FROM (SELECT *, (row_number() OVER (PARTITION BY symbol ORDER BY i) - 1) // 10 AS g FROM k0) GROUP BY symbol, g),
kk AS (SELECT symbol, 'open' AS kind, fold, i, ret FROM k1 UNION ALL SELECT symbol, 'complete', fold, i, ret FROM k2 UNION ALL SELECT symbol, 'grouped', fold, i, ret FROM k3),
ks AS (SELECT symbol, kind, ret AS r, CAST(row_number() OVER (PARTITION BY symbol, kind ORDER BY fold, i) - 1 AS INTEGER) AS i, count(*) OVER (PARTITION BY symbol, kind) AS n FROM kk QUALIFY n > 2),
kr AS (SELECT symbol, kind, i, r FROM ks), {sorted_sql('kr', keys, 40, 5)}, lv(prob) AS (VALUES (0.10::DOUBLE)), {mean_theta_sql('kr', keys)}, {bca_sql(keys)},
ba AS (SELECT symbol, kind, count(*) AS n, avg(r) AS m, stddev_samp(r) AS sd FROM kr GROUP BY ALL),
bt AS (SELECT *, m - sd / sqrt(n) * {inverse_t} AS t_bound FROM ba),
pc AS (SELECT symbol, kind, s[greatest(CAST(floor(0.1::DOUBLE * (b + 1)) AS INTEGER), 1)] AS pl, s[b + 1 - greatest(CAST(floor(0.1::DOUBLE * (b + 1)) AS INTEGER), 1)] AS ph FROM so)"""
    add(
        "mean_bounds",
        lambda s, d: q(tools.mean_bounds(bars(s, d), 40, 5, **folds)),
        sql("symbol, kind, n, round(m, 6) AS mean, round(t_bound, 6) AS t_bound, round(pl, 6) AS percentile, round(2 * m - ph, 6) AS pivot, round(lo, 6) AS bca", kinds, "bt JOIN pc USING (symbol, kind) JOIN bc USING (symbol, kind)"),
    )
    fold_means = f"{crossover_folds_sql(6, n_train, n_test, True)}, fm AS (SELECT symbol, fold, avg(ret) * 25200 AS ret FROM oos GROUP BY symbol, fold)"
    add("fold_returns", lambda s, d: q(tools.fold_returns(bars(s, d), 6, n_train, n_test)), sql("symbol, fold, round(ret, 6) AS ret", fold_means, "fm"))
    sides = f"""{fold_means}, sf AS (SELECT symbol, list_sort(list(ret)) AS s, CAST(count(*) AS INTEGER) AS n FROM fm GROUP BY symbol),
sm AS (SELECT *, greatest(CAST(floor(0.1::DOUBLE * (n + 1)) AS INTEGER), 1) AS m FROM sf),
sd AS (SELECT symbol, 'lower' AS side, n, m, s[m] AS b FROM sm UNION ALL SELECT symbol, 'upper', n, m, s[n + 1 - m] FROM sm)"""
    nd, md = "CAST(n AS DOUBLE)", "CAST(m AS DOUBLE)"
    add(
        "return_bounds",
        lambda s, d: q(tools.return_bounds(bars(s, d), 6, n_train, n_test)),
        sql(
            f"symbol, n, side, m, round(b, 6) AS bound, round(1 - {tail_sql.order_tail(nd, '0.1::DOUBLE * 0.9', md)}, 6) AS optimistic, round({tail_sql.order_tail(nd, '0.1::DOUBLE * 1.1', md)}, 6) AS pessimistic, "
            f"round({tail_sql.quantile_confidence(nd, md, '0.05')}, 6) AS low_q, round({tail_sql.quantile_confidence(nd, md, '0.95')}, 6) AS high_q",
            sides, "sd",
        ),
    )
    add("bootstrap_coverage", lambda s, d: q(tools.coverage_study(s)), coverage_sql())
    add("drawdown_study", lambda s, d: q(tools.drawdown_study(s)), drawdown_sql())
    add("order_statistic_check", lambda s, d: q(tools.order_statistic_check(s)), order_sql())
    for criterion in grids.CRITERIA:
        add(f"training_bias_{criterion}", lambda s, d, c=criterion: q(tools.training_bias(s, criterion=c)), training_sql(criterion))
    for criterion in grids.CRITERIA:
        add(f"selection_bias_{criterion}", lambda s, d, c=criterion: q(tools.selection_bias(s, trend=0.05, criterion=c)), selection_sql(criterion))
    add("overlap_study", lambda s, d: q(tools.overlap_study(s)), overlap_sql())
    add("validation_study", lambda s, d: q(tools.validation_study(s)), validation_sql())
    add("chooser_report", lambda s, d: q(tools.chooser_report(tools.aligned(bars(s, d)), 60, 40, 4)), chooser_report_sql(60, 40, 4))
    add("chooser_drawdown", lambda s, d: q(tools.chooser_bounds(tools.aligned(bars(s, d)), 60, 40)), chooser_bounds_sql(60, 40))
    # at the reference's size: 2,000 resamples of 10,000 years; a SQL row a day would be five thousand million
    add("chooser_drawdown_full", lambda s, d: q(tools.chooser_bounds(tools.aligned(bars(s, d)), 60, 40, 2000, 10_000, 252, hashed=False)))

    def nets(s, d):
        df, names = tools.features_of(bars(s, d))
        return (names, *tools.market_nets(df, names))

    def coefficients(s, d):
        names, found, _ = nets(s, d)
        rows = found.select("symbol", "lam", "explained", F.posexplode("beta").alias("k", "beta"))
        return rows.select(F.get(F.array(*map(F.lit, names)), F.col("k")).alias("feature"), "beta", "lam", "explained", "symbol")

    add("elastic_net", coefficients)

    def predictions(s, d):
        _, _, scored = nets(s, d)
        return backtest.out_of_sample(scored.where("test AND pred IS NOT NULL AND target IS NOT NULL"), "pred", "target")

    add("elastic_net_out_of_sample", predictions)

    def penalty_rows(s, d):
        df, names = tools.features_of(bars(s, d), rsi_periods=(10, 14))
        return tools.penalty_table(df, names, n_test=60, steps=20)

    add("penalty_table", penalty_rows)

    def combined(s, d):
        rows = tools.combined_models(bars(s, d), n_test=60)
        return backtest.out_of_sample(rows, "pred", "target").join(rows.groupBy("symbol").agg(F.max("model").alias("model")), "symbol")

    add("combined_model", combined)
    pairs = [(2, 6), (4, 6), (4, 12), (8, 12)]
    names = [f"f{a}_{b}" for a, b in pairs]
    cells = [(a, b) for k, a in enumerate(names) for b in names[k:]]

    def gram(s, d):
        df = bars(s, d).select("symbol", "i", *[ind.ma_cross("x", a, b).alias(n) for (a, b), n in zip(pairs, names, strict=True)], ind.targets("x").alias("target")).where("i >= 11 AND target IS NOT NULL")
        return q(df.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col(a) * F.col(b)).alias(f"{a}__{b}") for a, b in cells], *[F.sum(F.col(a) * F.col("target")).alias(f"{a}__y") for a in names]))

    feats = "q AS (SELECT symbol, i, " + ", ".join(f"{full(b, f'avg(x) OVER {w(a)} - avg(x) OVER {w(b)}')} AS f{a}_{b}" for a, b in pairs) + ", lead(x) OVER (PARTITION BY symbol ORDER BY i) - x AS target FROM bars)"
    add("gram_moments", gram, sql("symbol, count(*) AS n, " + ", ".join(f"round(sum({a} * {b}), 6) AS {a}__{b}" for a, b in cells) + ", " + ", ".join(f"round(sum({a} * target), 6) AS {a}__y" for a in names), feats, "q", "WHERE i >= 11 AND target IS NOT NULL GROUP BY symbol"))

    def evolved(s, d):
        found = tools.evolved_systems(bars(s, d), 20, 12, 3)
        rows = [(k, v, y, float(best[k]), float(value), x) for x, (best, value, curves) in found.items() for k, v, y in curves]
        return s.createDataFrame(rows, "parameter int, value double, total double, best double, best_total double, symbol string")

    add("differential_evolution", evolved)

    def sensitivities(s, d):
        bounds = optimize.Bounds((-3.0, -3.0), (3.0, 3.0))
        best, _, seen = optimize.differential_evolution(optimize.sphere, bounds, 20, 20, seed=4)
        found = optimize.parameter_correlation(np.concatenate([p for p, _ in seen]), np.concatenate([v for _, v in seen]))
        rows = [(k, v, y, float(found["deviation"][k])) for k, v, y in optimize.sensitivity(optimize.sphere, best, bounds, 10)]
        return s.createDataFrame(rows, "parameter int, value double, criterion double, deviation double")

    add("sensitivity_curves", sensitivities)

    def brent(s, d):
        (a, _), (b, _), (c, _) = optimize.global_max(lambda x: -((x - 2) ** 2) + 5, 0.5, 1.5)
        x, y = optimize.brent_max(lambda x: -((x - 2) ** 2) + 5, a, b, c)
        return s.createDataFrame([(round(x, 4), round(y, 6))], "x double, y double")

    add("brent_maximum", brent, "SELECT 2.0::DOUBLE AS x, 5.0::DOUBLE AS y")

    def penalties(s, d):
        df = bars(s, d).select("symbol", "i", *[ind.ma_cross("x", a, b).alias(n) for (a, b), n in zip(pairs, names, strict=True)], ind.targets("x").alias("target"))
        return market_models.paths(df, names, "target", 0.5, steps=20).select("lam", *[F.get("beta", F.lit(k)).alias(n) for k, n in enumerate(names)], "symbol")

    add("lambda_path", penalties)
