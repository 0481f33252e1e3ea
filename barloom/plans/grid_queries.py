"""Grids, walk-forward and backtests."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import backtest, grids, indicators as ind, resample
from ..sources import tables
from . import catalog, tools
from .indicator_queries import O, sql, w

MOST = 12
PRE = "(PARTITION BY symbol ORDER BY i ROWS UNBOUNDED PRECEDING)"


def rows_sql(most: int, own: bool = False, exclusive: bool = False) -> str:
    top = most - 1 if exclusive else most
    start = "long - 1" if own else str(most - 1)
    return f"""sums AS (SELECT symbol, i, x, sum(x) OVER {PRE} AS s, lead(x) OVER {O} - x AS nx FROM bars),
means AS (SELECT symbol, i, nx, k, (s - coalesce(lag(s, CAST(k AS INTEGER)) OVER (PARTITION BY symbol, k ORDER BY i), 0.0)) / k AS m FROM sums, range(1, {top + 1}) g(k)),
rows_ AS (SELECT a.symbol, a.i, CAST(a.k AS INTEGER) AS short, CAST(b.k AS INTEGER) AS long, CAST(sign(a.m - b.m) AS INTEGER) AS sg, sign(a.m - b.m) * a.nx AS ret
  FROM means a JOIN means b ON b.symbol = a.symbol AND b.i = a.i AND a.k < b.k WHERE a.nx IS NOT NULL), rows2 AS (SELECT * FROM rows_ WHERE i >= {start})"""


WINS, LOSSES = "sum(greatest(ret, 0.0))", "sum(greatest(-ret, 0.0))"
GRID = f"grid AS (SELECT symbol, short, long, sum(ret) AS total, avg(ret) AS mean, ({WINS} + 1e-60) / ({LOSSES} + 1e-60) AS profit_factor, avg(ret) / (sqrt(greatest(avg(ret * ret) - avg(ret) * avg(ret), 0.0)) + 1e-8) AS sharpe, CAST(sum(CASE WHEN sg = 1 THEN 1 ELSE 0 END) AS BIGINT) AS n_long, CAST(sum(CASE WHEN sg = -1 THEN 1 ELSE 0 END) AS BIGINT) AS n_short FROM rows2 GROUP BY 1, 2, 3)"
GRID_OUT = "symbol, short, long, round(total, 6) AS total, round(mean, 6) AS mean, round(profit_factor, 6) AS profit_factor, round(sharpe, 6) AS sharpe, n_long, n_short"



def criteria_sql(ret: str, traded: str) -> str:
    """The criteria of the rows where ``traded`` holds."""
    r, n = f"(CASE WHEN {traded} THEN {ret} ELSE 0.0 END)", f"sum(CASE WHEN {traded} THEN 1 ELSE 0 END)"
    mean = f"(sum({r}) / ({n} + 1e-30))"
    return (
        f"round(sum({r}), 6) AS total, round({mean}, 6) AS mean, round((sum(greatest({r}, 0.0)) + 1e-60) / (sum(greatest(-{r}, 0.0)) + 1e-60), 6) AS profit_factor, "
        f"round({mean} / sqrt(greatest(sum({r} * {r}) / ({n} + 1e-30) - {mean} * {mean}, 1e-20)), 6) AS sharpe, CAST({n} AS BIGINT) AS n_bars"
    )


def breakout_sql(look: int, steps: int) -> str:
    """``pos``: symbol, look, k, i, x, nx, pos and the bar ``since`` when it was decided."""
    run = "(PARTITION BY symbol, look, k ORDER BY i ROWS UNBOUNDED PRECEDING)"
    return f"""sums AS (SELECT symbol, i, x, sum(x) OVER {PRE} AS s, lead(x) OVER {O} - x AS nx FROM bars),
means AS (SELECT symbol, i, x, nx, CAST(k AS INTEGER) AS look, (s - coalesce(lag(s, CAST(k AS INTEGER)) OVER (PARTITION BY symbol, k ORDER BY i), 0.0)) / k AS m FROM sums, range(2, {look + 1}) g(k)),
dec AS (SELECT symbol, look, CAST(k AS INTEGER) AS k, i, x, nx, CASE WHEN x > (1 + k * 0.01) * m THEN 1 WHEN x < m THEN 0 END AS d FROM means, range(1, {steps + 1}) h(k) WHERE i >= {look - 1}),
pos AS (SELECT *, coalesce(last_value(d IGNORE NULLS) OVER {run}, 0) AS pos, max(CASE WHEN d IS NOT NULL THEN i END) OVER {run} AS since FROM dec)"""


def breakout_folds_sql(most: int, steps: int, n_train: int, n_test: int, criterion: str = "mean", traded: str = "p = 1") -> str:
    """``tst``: symbol, fold, i, nx, p (the position) of each fold's test by the system best in its training slice."""
    best = {
        "mean": "sum(p * nx * w) / (sum(w) + 1e-30)",
        "profit_factor": "(sum(greatest(p * nx * w, 0.0)) + 1e-60) / (sum(greatest(-p * nx * w, 0.0)) + 1e-60)",
        "sharpe": "sum(p * nx * w) / (sum(w) + 1e-30) / sqrt(greatest(sum(pow(p * nx * w, 2)) / (sum(w) + 1e-30) - pow(sum(p * nx * w) / (sum(w) + 1e-30), 2), 1e-20))",
    }[criterion]
    return f"""{breakout_sql(most, steps)}, fd AS (SELECT CAST(k AS INTEGER) AS fold, k * {n_test} AS a FROM range(0, 1000) g(k)),
trn AS (SELECT symbol, fold, look, k, i, nx, CASE WHEN since >= a + {most - 1} THEN pos ELSE 0 END AS p FROM pos JOIN fd ON i >= a + {most - 1} AND i <= a + {n_train - 2} WHERE nx IS NOT NULL),
trw AS (SELECT *, CASE WHEN {traded} THEN 1 ELSE 0 END AS w FROM trn),
sco AS (SELECT symbol, fold, look, k, round({best}, 10) AS c FROM trw GROUP BY 1, 2, 3, 4),
bst AS (SELECT symbol, fold, look, k FROM sco QUALIFY row_number() OVER (PARTITION BY symbol, fold ORDER BY c DESC, look, k) = 1),
tst AS (SELECT p.symbol, b.fold, p.i, p.nx, CASE WHEN since >= a + {most - 1} THEN pos ELSE 0 END AS p FROM pos p JOIN bst b USING (symbol, look, k) JOIN fd ON fd.fold = b.fold WHERE p.nx IS NOT NULL AND p.i >= a + {n_train - 1} AND p.i < a + {n_train - 1 + n_test})"""


def kind_sql(kind: int, source: str = "tst") -> str:
    """Rows ``symbol, fold, i, ret`` of all bars, bars in the market, or completed trades."""
    if kind < 2:
        return f"SELECT symbol, fold, i, p * nx AS ret FROM {source}" + (" WHERE p = 1" if kind else "")
    opened = f"SELECT *, CASE WHEN p = 1 AND coalesce(lag(p) OVER (PARTITION BY symbol, fold ORDER BY i), 0) = 0 THEN 1 ELSE 0 END AS o, max(i) OVER (PARTITION BY symbol, fold) AS e FROM {source}"
    return f"SELECT symbol, fold, max(i) AS i, sum(nx) AS ret FROM (SELECT *, sum(o) OVER (PARTITION BY symbol, fold ORDER BY i ROWS UNBOUNDED PRECEDING) AS t FROM ({opened})) WHERE p = 1 GROUP BY symbol, fold, t HAVING min(i) < max(e)"


def crossover_folds_sql(most: int, n_train: int, n_test: int, own: bool = False) -> str:
    """``oos``: the out-of-sample rows by the pair that was best in each fold; with ``own`` each pair has its own first bar and divisor."""
    warm, mean = ("long - 1", f"sum(ret) / ({n_train} - long)") if own else (str(most - 1), "avg(ret)")
    return f"""{rows_sql(most, own, own)}, fd AS (SELECT CAST(k AS INTEGER) AS fold, k * {n_test} AS a FROM range(0, 1000) g(k)),
ins AS (SELECT symbol, fold, short, long, round({mean}, 10) AS s FROM rows2 JOIN fd ON i >= a + {warm} AND i <= a + {n_train - 2} GROUP BY 1, 2, 3, 4),
bst AS (SELECT * FROM ins QUALIFY row_number() OVER (PARTITION BY symbol, fold ORDER BY s DESC, long, short) = 1),
oos AS (SELECT r.symbol, b.fold, r.short, r.long, r.i, r.ret, b.s FROM rows2 r JOIN bst b USING (symbol, short, long) JOIN fd ON fd.fold = b.fold WHERE r.i >= a + {n_train - 1} AND r.i < a + {n_train - 1 + n_test})"""


ALIGNED = "al AS (SELECT symbol, x, CAST(row_number() OVER (PARTITION BY symbol ORDER BY dt) - 1 AS INTEGER) AS i FROM bars WHERE dt IN (SELECT dt FROM bars GROUP BY dt HAVING count(*) = (SELECT count(DISTINCT symbol) FROM bars)))"


def chooser_sql(window: int, out_window: int, source: str = "al", key: str = "") -> str:
    """``p`` (picks by criterion) and ``z`` (ranked by what the criteria earned); ``key`` is a further key with its comma."""
    n = window - 1
    by = f"{key}symbol"
    return f"""h AS (SELECT {by}, i, x - lag(x) OVER (PARTITION BY {by} ORDER BY i) AS r, lead(x) OVER (PARTITION BY {by} ORDER BY i) - x AS nx FROM {source}),
s AS (SELECT {by}, i, nx, round(sum(r) OVER w, 10) AS c0, round((sum(r) OVER w / {n}) / sqrt(greatest(sum(r * r) OVER w / {n} - pow(sum(r) OVER w / {n}, 2), 0.0) + 1e-60), 10) AS c1, round((sum(greatest(r, 0.0)) OVER w + 1e-60) / (sum(greatest(-r, 0.0)) OVER w + 1e-60), 10) AS c2 FROM h WINDOW w AS (PARTITION BY {by} ORDER BY i ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)),
l AS (SELECT {by}, i, nx, CAST(c AS INTEGER) AS criterion, [c0, c1, c2][c + 1] AS v FROM s, range(3) g(c) WHERE i >= {n} AND nx IS NOT NULL),
p AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY {key}i, criterion ORDER BY v DESC, symbol) = 1),
o AS (SELECT *, round(sum(nx) OVER w, 10) AS sm, count(*) OVER w AS n FROM p WINDOW w AS (PARTITION BY {key}criterion ORDER BY i ROWS BETWEEN {out_window} PRECEDING AND 1 PRECEDING)),
z AS (SELECT *, row_number() OVER (PARTITION BY {key}i ORDER BY sm DESC, criterion) AS kk FROM o WHERE n = {out_window})"""


SIGNAL_ARGS = dict(long=20, short_pct=40.0, short_thr=8.0, long_thr=8.0)
SIGNALS = f"sgn AS (SELECT symbol, i, x, CASE WHEN i < 20 THEN 0 WHEN c > 0.0008 THEN 1 WHEN c < -0.0008 THEN -1 ELSE 0 END AS signal FROM (SELECT *, avg(x) OVER {w(8, -1)} / avg(x) OVER {w(20, -1)} - 1 AS c FROM bars) q)"
C = 0.001
LEGS = f"""{SIGNALS}, ps AS (SELECT *, exp(x) AS p, coalesce(last_value(nullif(signal, 0) IGNORE NULLS) OVER {PRE}, 0) AS pos FROM sgn),
op AS (SELECT *, CASE WHEN pos <> 0 AND pos <> coalesce(lag(pos) OVER {O}, 0) THEN 1 ELSE 0 END AS o FROM ps),
lg AS (SELECT *, CAST(sum(o) OVER {PRE} AS BIGINT) AS leg, max(i) OVER (PARTITION BY symbol) AS e, last_value(p) OVER (PARTITION BY symbol ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS lp FROM op),
st AS (SELECT symbol, leg, i AS entry_index, p AS entry_price, pos AS side, lead(i) OVER {O} IS NULL AS forced, coalesce(lead(i) OVER {O}, e) AS exit_index, coalesce(lead(p) OVER {O}, lp) AS exit_price FROM lg WHERE o = 1),
rt AS (SELECT *, CASE WHEN side = 1 THEN exit_price / entry_price ELSE entry_price / exit_price END - 1 AS r FROM st),
gr AS (SELECT *, coalesce(sum(ln(1 - {C}) + ln(1 + r - {C})) OVER (PARTITION BY symbol ORDER BY leg ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS g FROM rt),
tr AS (SELECT *, exp(g) * 10000 AS cash, exp(g) * 10000 * (1 - {C}) AS opened FROM gr)"""
EQUITY = f"""{LEGS}, eq0 AS (SELECT l.symbol, l.i, l.signal, l.pos, l.o, l.p, t.opened, t.entry_price, t.side, lag(t.opened) OVER (PARTITION BY l.symbol ORDER BY l.i) AS before, coalesce(lag(l.pos) OVER (PARTITION BY l.symbol ORDER BY l.i), 0) AS was
  FROM lg l LEFT JOIN tr t ON t.symbol = l.symbol AND t.leg = l.leg),
eq AS (SELECT symbol, i, CASE WHEN o = 1 THEN was ELSE pos END AS position, CASE WHEN pos = 0 THEN 10000.0 WHEN o = 1 THEN coalesce(before, 10000.0) WHEN signal = 0 THEN opened * CASE WHEN side = 1 THEN p / entry_price ELSE entry_price / p END ELSE opened END AS equity FROM eq0)"""
SUMMARY = f"""{EQUITY}, dd AS (SELECT symbol, max((pk - equity) / pk) * 100 AS max_drawdown FROM (SELECT *, greatest(max(equity) OVER {PRE}, 10000.0) AS pk FROM eq) GROUP BY symbol),
sm AS (SELECT symbol, arg_max(opened * (1 + r - {C}), leg) AS final_budget, CAST(count(*) * 2 AS BIGINT) AS num_trades, CAST(sum(CASE WHEN opened * r > 0 THEN 1 ELSE 0 END) AS BIGINT) AS num_wins, CAST(sum(CASE WHEN opened * r > 0 THEN 0 ELSE 1 END) AS BIGINT) AS num_losses,
  sum(cash * {C} + opened * {C}) AS total_costs, CASE WHEN stddev_pop(r / (1 + r - {C})) > 0 THEN avg(r / (1 + r - {C})) / stddev_pop(r / (1 + r - {C})) * sqrt(252.0) ELSE 0.0 END AS sharpe_ratio FROM tr GROUP BY symbol)"""


def signals(spark, sf_dir):
    return grids.threshold_signals(tables.bars(spark, sf_dir), **SIGNAL_ARGS, exclude_current=True)


def register(add) -> None:
    q = catalog.rounded
    grid = lambda **kw: lambda s, d: q(grids.crossover_grid(tables.bars(s, d), "x", MOST, **kw))
    add("crossover_grid", grid(), sql(GRID_OUT, f"{rows_sql(MOST)}, {GRID}", "grid"))
    add("crossover_grid_own_start", grid(own_start=True, exclusive=True), sql(GRID_OUT, f"{rows_sql(MOST, True, True)}, {GRID}", "grid"))
    r1 = "CASE WHEN sg = 1 THEN ret ELSE 0.0 END"
    n1 = "(sum(CASE WHEN sg = 1 THEN 1 ELSE 0 END) + 1e-30)"
    one_side = f"""{rows_sql(MOST)}, grid AS (SELECT symbol, short, long, sum({r1}) AS total, sum({r1}) / {n1} AS mean, (sum(greatest({r1}, 0.0)) + 1e-60) / (sum(greatest(-{r1}, 0.0)) + 1e-60) AS profit_factor,
  sum({r1}) / {n1} / sqrt(greatest(sum(pow({r1}, 2)) / {n1} - pow(sum({r1}) / {n1}, 2), 1e-20)) AS sharpe, CAST(sum(CASE WHEN sg = 1 THEN 1 ELSE 0 END) AS BIGINT) AS n_long, CAST(sum(CASE WHEN sg = -1 THEN 1 ELSE 0 END) AS BIGINT) AS n_short FROM rows2 GROUP BY 1, 2, 3)"""
    add("crossover_grid_long_only", grid(side="long"), sql(GRID_OUT, one_side, "grid"))
    add(
        "crossover_best",
        lambda s, d: q(grids.best(grids.crossover_grid(tables.bars(s, d), "x", MOST), "total", ["long", "short"], ["symbol"], ["short", "long", "total"])),
        sql("symbol, short, long, round(total, 6) AS total", f"{rows_sql(MOST)}, {GRID}, b AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY total DESC, long, short) AS k FROM grid)", "b", "WHERE k = 1"),
    )
    add(
        "returns_matrix",
        lambda s, d: q(grids.crossover_returns(tables.bars(s, d), "x", 6).select("symbol", "i", "short", "long", "ret"), 8),
        sql("symbol, i, short, long, round(ret, 8) AS ret", rows_sql(6), "rows2"),
    )
    look = 6
    brk = breakout_sql(look, 3)
    breakout = lambda s, d: grids.breakout(tables.bars(s, d), "x", look, 3)
    for name, all_bars, flag in (("breakout_grid", False, "pos = 1"), ("breakout_grid_all_bars", True, "true")):
        add(
            name,
            lambda s, d, all_bars=all_bars: q(breakout(s, d).where("_next IS NOT NULL").groupBy("symbol", "look", "k").agg(*grids.criteria(F.col("ret"), F.lit(True) if all_bars else F.col("pos") == 1))),
            sql(f"symbol, look, k, {criteria_sql('pos * nx', flag)}", brk, "pos", "WHERE nx IS NOT NULL GROUP BY symbol, look, k"),
        )
    kinds = f"{brk}, p2 AS (SELECT * FROM pos WHERE nx IS NOT NULL), opn AS (SELECT *, CASE WHEN pos = 1 AND coalesce(lag(pos) OVER (PARTITION BY symbol, look, k ORDER BY i), 0) = 0 THEN 1 ELSE 0 END AS o, max(i) OVER (PARTITION BY symbol) AS e FROM p2), trd AS (SELECT *, sum(o) OVER (PARTITION BY symbol, look, k ORDER BY i ROWS UNBOUNDED PRECEDING) AS trade FROM opn)"
    keys = ["symbol", "look", "k"]
    add("breakout_trades", lambda s, d: q(grids.breakout_returns(breakout(s, d), 2, keys), 8), sql("symbol, look, k, max(i) AS i, round(sum(nx), 8) AS ret", kinds, "trd", "WHERE pos = 1 GROUP BY symbol, look, k, trade HAVING min(i) < max(e)"))
    add("breakout_open_bars", lambda s, d: q(grids.breakout_returns(breakout(s, d), 1, keys), 8), sql("symbol, look, k, i, round(nx, 8) AS ret", kinds, "p2", "WHERE pos <> 0"))
    rev = f"b AS (SELECT symbol, x - lag(x, 5) OVER {O} AS rise, lag(x) OVER {O} - x AS drp, lead(lo, 2) OVER {O} - lead(lo, 1) OVER {O} AS ret FROM bars), c AS (SELECT * FROM b WHERE rise IS NOT NULL AND ret IS NOT NULL)"
    add(
        "reversal_grid",
        lambda s, d: q(grids.reversal_grid(tables.bars(s, d), 5)),
        sql("symbol, CAST(a AS INTEGER) AS rise, CAST(d AS INTEGER) AS \"drop\", round(sum(CASE WHEN rise / 0.005 + 1e-9 >= a AND drp / 0.0005 + 1e-9 >= d THEN ret ELSE 0.0 END), 6) AS total, CAST(sum(CASE WHEN rise / 0.005 + 1e-9 >= a AND drp / 0.0005 + 1e-9 >= d THEN 1 ELSE 0 END) AS BIGINT) AS n_long", rev, "c, range(1, 51) g(a), range(1, 51) h(d)", "GROUP BY 1, 2, 3"),
    )
    ev = f"SELECT symbol, i, x, lead(x) OVER {O} - x AS nx, avg(x) OVER {w(8)} AS s, avg(x) OVER {w(20)} AS l FROM bars"
    for name, ratio, change in (("threshold_ratio", True, "s / l - 1"), ("threshold_log_diff", False, "s - l")):
        add(
            f"{name}_system",
            lambda s, d, ratio=ratio: q(
                grids.threshold_signals(tables.bars(s, d), **SIGNAL_ARGS, ratio=ratio).withColumn("nx", ind.targets("x")).where("nx IS NOT NULL").groupBy("symbol")
                .agg(F.sum(F.col("signal") * F.col("nx")).alias("total"), F.sum(F.abs("signal")).cast("long").alias("n_trades"))
            ),
            sql("symbol, round(sum(sg * nx), 6) AS total, CAST(sum(abs(sg)) AS BIGINT) AS n_trades", f"e AS ({ev}), f AS (SELECT symbol, nx, CASE WHEN i < 19 THEN 0 WHEN {change} > 0.0008 THEN 1 WHEN {change} < -0.0008 THEN -1 ELSE 0 END AS sg FROM e WHERE nx IS NOT NULL)", "f", "GROUP BY symbol"),
        )
    add("live_signals", lambda s, d: signals(s, d).select("symbol", "i", "signal"), sql("symbol, i, signal", SIGNALS, "sgn"))
    add(
        "backtest_trades",
        lambda s, d: q(
            backtest.trades(signals(s, d), 10_000.0, 0.1).select(
                "symbol", "entry_index", "entry_price", "exit_index", "exit_price", "trade_type", (F.col("pnl") / F.col("budget")).alias("pnl_share"), "return_pct", F.log(F.col("budget") / 10_000.0).alias("log_budget")
            ), 5,
        ),
        sql(f"symbol, entry_index, round(entry_price, 5) AS entry_price, exit_index, round(exit_price, 5) AS exit_price, CASE WHEN side = 1 THEN 'LONG' ELSE 'SHORT' END AS trade_type, round(r / (1 + r - {C}), 5) AS pnl_share, round(r * 100, 5) AS return_pct, round(ln(opened * (1 + r - {C}) / 10000.0), 5) AS log_budget", LEGS, "tr"),
    )
    # budgets compound over hundreds of trades, so they are compared as logs
    add("backtest_equity", lambda s, d: backtest.equity(signals(s, d), 10_000.0, 0.1).select("symbol", "i", "position", F.round(F.log(F.col("equity") / 10_000.0), 6).alias("log_equity")), sql("symbol, i, position, round(ln(equity / 10000.0), 6) AS log_equity", EQUITY, "eq"))
    add(
        "backtest_summary",
        lambda s, d: q(
            backtest.summary(signals(s, d), 10_000.0, 0.1).select(
                "symbol", F.log(F.col("final_budget") / 10_000.0).alias("log_growth"), "num_trades", "num_wins", "num_losses", "win_rate",
                F.log(F.col("total_costs")).alias("log_costs"), "max_drawdown", "sharpe_ratio",
            ), 5,
        ),
        sql("symbol, round(ln(final_budget / 10000.0), 5) AS log_growth, num_trades, num_wins, num_losses, round(num_wins * 100.0 / (num_wins + num_losses), 5) AS win_rate, round(ln(total_costs), 5) AS log_costs, round(max_drawdown, 5) AS max_drawdown, round(sharpe_ratio, 5) AS sharpe_ratio", SUMMARY, "sm JOIN dd USING (symbol)"),
    )
    wf = crossover_folds_sql(8, 400, 100)
    add(
        "walk_forward",
        lambda s, d: q(
            grids.walk_forward(grids.crossover_returns(tables.bars(s, d), "x", 8), 400, 100, ["short", "long"], ["symbol"], 7).groupBy("symbol", "fold", "short", "long")
            .agg(F.count(F.lit(1)).alias("n"), F.sum("ret").alias("out_of_sample"), F.max("in_sample").alias("in_sample"))
        ),
        sql("symbol, fold, short, long, count(*) AS n, round(sum(ret), 6) AS out_of_sample, round(max(s), 6) AS in_sample", wf, "oos", "GROUP BY 1, 2, 3, 4"),
    )
    add(
        "crunched_returns",
        lambda s, d: q(grids.crunch(tables.bars(s, d).withColumn("ret", ind.targets("x")).where("ret IS NOT NULL"), "ret", "i", 10, ["symbol"]), 8),
        sql("symbol, CAST((i // 10) AS BIGINT) AS grp, round(avg(r), 8) AS ret", f"q AS (SELECT symbol, i, lead(x) OVER {O} - x AS r FROM bars)", "q", "WHERE r IS NOT NULL GROUP BY 1, 2"),
    )
    add(
        "market_chooser",
        lambda s, d: q(resample.chooser(tools.aligned(tables.bars(s, d)), 60, 40).select("i", "criterion", "market", "ret"), 8),
        sql("i, criterion, symbol AS market, round(nx, 8) AS ret", f"{ALIGNED}, {chooser_sql(60, 40)}", "z", "WHERE kk = 1"),
    )
