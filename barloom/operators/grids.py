"""Parameter grids as relations: crossovers, breakouts, reversals, walk-forward."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .indicators import MARKET, Series


def with_means(df: DataFrame, x: str, most: int, s: Series = MARKET) -> DataFrame:
    """``df`` with ``m``: the means of the last 1 to ``most`` values, from one running sum.

    A frame per lookback would be summed anew at every bar; differences of the
    running sum cost one subtraction each.
    """
    held = df.withColumn("_s", F.sum(x).over(s.rows(Window.unboundedPreceding)))
    means = [(F.col("_s") - F.coalesce(s.lag("_s", k), F.lit(0.0))) / k for k in range(1, most + 1)]
    return held.withColumn("m", F.array(*means)).drop("_s")


def pairs(most: int, exclusive: bool = False) -> Column:
    """All (short, long) with short < long <= most, in loop order: a constant array to explode beside each bar."""
    top = most - 1 if exclusive else most
    return F.array(*[F.struct(F.lit(s).alias("short"), F.lit(lo).alias("long")) for lo in range(2, top + 1) for s in range(1, lo)])


def crossover_returns(df: DataFrame, x: str = "x", most: int = 20, own_start: bool = False, exclusive: bool = False, s: Series = MARKET) -> DataFrame:
    """``by, i, short, long, signal, ret``: each pair's position and return at each bar.

    Bars count from ``most`` - 1 on, or from each pair's own long lookback.
    """
    held = with_means(df, x, most, s).withColumn("_next", s.lead(x) - F.col(x))
    held = held.where(F.col("_next").isNotNull())
    if not own_start:
        held = held.where(F.col(s.i) >= most - 1)
    out = held.select(*s.by, s.i, "m", "_next", F.explode(pairs(most, exclusive)).alias("_p")).select("*", "_p.short", "_p.long")
    if own_start:
        out = out.where(F.col(s.i) >= F.col("long") - 1)
    signal = F.signum(F.expr("element_at(m, short)") - F.expr("element_at(m, long)")).cast("int")
    return out.select(*s.by, s.i, "short", "long", signal.alias("signal"), (signal * F.col("_next")).alias("ret"))


CRITERIA = ("mean", "profit_factor", "sharpe")


def criteria(ret: Column, traded: Column | None = None) -> list[Column]:
    """Total, mean, profit factor and Sharpe ratio of returns, or of those where ``traded`` holds, and their number.

    Without ``traded`` every row counts, and the ratio's guard is added to the
    deviation; with it the guards keep a system without trades at 0.
    """
    r = ret if traded is None else F.when(traded, ret).otherwise(F.lit(0.0))
    total, squares = F.sum(r), F.sum(r * r)
    wins, losses = F.sum(F.greatest(r, F.lit(0.0))), F.sum(F.greatest(-r, F.lit(0.0)))
    if traded is None:
        n = F.count(F.lit(1))
        mean = total / n
        sharpe = mean / (F.sqrt(F.greatest(squares / n - mean * mean, F.lit(0.0))) + 1e-8)
    else:
        n = F.sum(traded.cast("long"))
        mean = total / (n + F.lit(1e-30))
        sharpe = mean / F.sqrt(F.greatest(squares / (n + F.lit(1e-30)) - mean * mean, F.lit(1e-20)))
    pf = (wins + F.lit(1e-60)) / (losses + F.lit(1e-60))
    return [total.alias("total"), mean.alias("mean"), pf.alias("profit_factor"), sharpe.alias("sharpe"), n.alias("n_bars")]


def crossover_grid(df: DataFrame, x: str = "x", most: int = 20, side: str = "both", s: Series = MARKET, **kw) -> DataFrame:
    """One row a series and pair: total, mean, profit factor, Sharpe and trade counts.

    With ``side`` long or short only the bars of such positions count.
    """
    rows = crossover_returns(df, x, most, s=s, **kw)
    traded = None if side == "both" else F.col("signal") == (1 if side == "long" else -1)
    return rows.groupBy(*s.by, "short", "long").agg(
        *criteria(F.col("ret"), traded)[:-1],
        F.sum((F.col("signal") == 1).cast("long")).alias("n_long"),
        F.sum((F.col("signal") == -1).cast("long")).alias("n_short"),
    )


def best(df: DataFrame, value: str, ties: list[str], by: list[str], keep: list[str]) -> DataFrame:
    """The row with the highest value of each group; of equal ones, to ten places, the first in tie order wins.

    Equal systems have equal sums but for the order in which they were added up.
    """
    order = F.struct(F.round(value, 10), *[-F.col(t) for t in ties])
    return df.groupBy(*by).agg(F.max_by(F.struct(*keep), order).alias("_best")).select(*by, "_best.*")


def breakout(df: DataFrame, x: str = "x", most: int = 20, steps: int = 10, s: Series = MARKET) -> DataFrame:
    """``by, look, k, i, pos, since, ret``: in the market above (1 + k/100) times the mean, out below it, else as before.

    The position is the last decision that was made, at bar ``since``: a running
    last value that skips bars without one.
    """
    held = with_means(df, x, most, s).withColumn("_next", s.lead(x) - F.col(x)).where(F.col(s.i) >= most - 1)
    grid = F.array(*[F.struct(F.lit(lo).alias("look"), F.lit(k).alias("k")) for lo in range(2, most + 1) for k in range(1, steps + 1)])
    rows = held.select(*s.by, s.i, F.col(x).alias("_x"), "m", "_next", F.explode(grid).alias("_g")).select("*", "_g.look", "_g.k")
    mean = F.expr("element_at(m, look)")
    decided = F.when(F.col("_x") > (F.col("k") * 0.01 + 1) * mean, 1).when(F.col("_x") < mean, 0)
    order = Window.partitionBy(*s.by, "look", "k").orderBy(s.i).rowsBetween(Window.unboundedPreceding, 0)
    made = F.when(decided.isNotNull(), F.struct(decided.alias("d"), F.col(s.i).alias("i")))
    rows = rows.withColumn("_d", F.last(made, ignorenulls=True).over(order)).withColumn("pos", F.coalesce("_d.d", F.lit(0)))
    return rows.select(*s.by, "look", "k", s.i, "pos", F.col("_d.i").alias("since"), "_x", F.col("_next"), (F.col("pos") * F.col("_next")).alias("ret"))


def restarted(rows: DataFrame, start: Column) -> DataFrame:
    """Breakout rows as if the system had been started out of the market at bar ``start``."""
    pos = F.when(F.col("since") >= start, F.col("pos")).otherwise(F.lit(0))
    return rows.withColumn("pos", pos).withColumn("ret", F.col("pos") * F.col("_next"))


def breakout_returns(rows: DataFrame, kind: int, keys: list[str], i: str = "i") -> DataFrame:
    """Returns of breakout positions: 0 all bars, 1 bars in the market, 2 completed trades.

    A trade that is open at the end is closed there, unless it was opened by the
    last bar's own decision.
    """
    rows = rows.where(F.col("_next").isNotNull())
    if kind == 0:
        return rows.select(*keys, i, "ret")
    if kind == 1:
        return rows.where("pos <> 0").select(*keys, i, "ret")
    order = Window.partitionBy(*keys).orderBy(i)
    held = rows.withColumn("_opens", ((F.col("pos") == 1) & (F.coalesce(F.lag("pos").over(order), F.lit(0)) == 0)).cast("int"))
    held = held.withColumn("trade", F.sum("_opens").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_end", F.max(i).over(Window.partitionBy(*keys)))
    trades = held.where("pos = 1").groupBy(*keys, "trade").agg(F.min(i).alias("_from"), F.max(i).alias(i), F.sum("ret").alias("ret"), F.max("_end").alias("_end"))
    return trades.where("_from < _end").drop("trade", "_from", "_end")


def reversal_grid(df: DataFrame, lookback: int, opens: str = "lo", closes: str = "x", rises: int = 50, drops: int = 50, s: Series = MARKET) -> DataFrame:
    """Long after a long rise and a short drop: total return for each pair of thresholds.

    A bar meets all thresholds up to its own rise and drop, so bars are folded to
    the highest pair each meets and the totals are running sums over both axes:
    the work is one pass over the bars plus one over the grid.
    """
    rise = F.col(closes) - s.lag(closes, lookback)
    drop = s.lag(closes) - F.col(closes)
    ret = s.lead(opens, 2) - s.lead(opens, 1)
    held = df.withColumn("_rise", rise).withColumn("_drop", drop).withColumn("_ret", ret).where("_rise IS NOT NULL AND _ret IS NOT NULL")
    cell = lambda v, step, most: F.greatest(F.least(F.floor(v / step + 1e-9), F.lit(most)), F.lit(0)).cast("int")
    cells = held.groupBy(*s.by, cell(F.col("_rise"), 0.005, rises).alias("rise"), cell(F.col("_drop"), 0.0005, drops).alias("drop")).agg(F.sum("_ret").alias("_t"), F.count(F.lit(1)).alias("_c"))
    axis = lambda n: F.explode(F.sequence(F.lit(1), F.lit(n)))
    grid = held.select(*s.by).distinct().select(*s.by, axis(rises).alias("rise")).select(*s.by, "rise", axis(drops).alias("drop"))
    full = grid.join(cells, [*s.by, "rise", "drop"], "left").withColumn("_t", F.coalesce("_t", F.lit(0.0))).withColumn("_c", F.coalesce("_c", F.lit(0)))

    def above(axis: str, other: str):
        return Window.partitionBy(*s.by, other).orderBy(F.col(axis).desc()).rowsBetween(Window.unboundedPreceding, 0)

    full = full.withColumn("_t", F.sum("_t").over(above("drop", "rise"))).withColumn("_c", F.sum("_c").over(above("drop", "rise")))
    return full.select(*s.by, "rise", "drop", F.sum("_t").over(above("rise", "drop")).alias("total"), F.sum("_c").over(above("rise", "drop")).alias("n_long"))


def threshold_signals(df: DataFrame, long: int, short_pct: float, short_thr: float, long_thr: float, ratio: bool = True, exclude_current: bool = False, x: str = "x", s: Series = MARKET) -> DataFrame:
    """``df`` with ``signal``: 1 where the means' change exceeds a threshold, -1 where it falls below the other.

    The change is a ratio less one or a difference; thresholds are in 1/10000.
    For evaluation the short lookback is cut to a whole number and the current
    bar is included; for live signals it is rounded and the bar is excluded.
    """
    short = int(0.01 * short_pct * long + (0.5 if exclude_current else 0))
    short = min(max(short, 1), long - 1)
    end = -1 if exclude_current else 0
    mean = lambda n: F.avg(x).over(s.rows(end - n + 1, end))
    change = F.try_divide(mean(short), mean(long)) - 1 if ratio else mean(short) - mean(long)
    ready = F.col(s.i) >= (long if exclude_current else long - 1)
    up, down = F.lit(long_thr / 10000.0), F.lit(-short_thr / 10000.0)
    signal = F.when(~ready, 0).when(F.col("_c") > up, 1).when(F.col("_c") < down, -1).otherwise(0)
    return df.withColumn("_c", change).withColumn("signal", F.coalesce(signal, F.lit(0))).drop("_c")


def penalized(total: Column, trades: Column, least: int) -> Column:
    """The criterion of a system that trades at least so often, else a very low value."""
    return F.when(trades < least, F.lit(-1e20)).otherwise(total)


def folds(n: int, n_train: int, n_test: int, omit: int = 0, extra: int = 0) -> list[tuple[int, int, int, int]]:
    """(fold, training start, test start, test end) of a walk forward; the last test may be shorter, ``extra`` cases are skipped after each."""
    return [(k, at, at + n_train, min(at + n_train + n_test, n)) for k, at in enumerate(range(0, n - n_train, n_test + extra))]


def training_folds(rows: DataFrame, n_train: int, n_test: int, warm: int | Column = 0, i: str = "i") -> DataFrame:
    """Each row with each ``fold`` in whose training slice its return lies.

    Fold f trains on the prices [f n_test, f n_test + n_train): the first
    ``warm`` of them only feed means, and the return from the last one is the first
    out of sample. A row belongs to n_train / n_test folds at most, so it is dealt to just those.
    """
    warm = warm if isinstance(warm, Column) else F.lit(warm)
    last = F.floor((F.col(i) - warm) / n_test)
    first = F.greatest(F.ceil((F.col(i) - (n_train - 2)) / n_test), F.lit(0))
    return rows.withColumn("fold", F.explode(F.when(first <= last, F.sequence(first.cast("int"), last.cast("int")))))


def test_folds(rows: DataFrame, n_train: int, n_test: int, i: str = "i") -> DataFrame:
    """The rows that some fold tests, with that ``fold``: decisions from the last training price on."""
    return rows.where(F.col(i) >= n_train - 1).withColumn("fold", F.floor((F.col(i) - (n_train - 1)) / n_test).cast("int"))


def walk_forward(returns: DataFrame, n_train: int, n_test: int, keys: list[str], by: list[str], warm: int | Column = 0, ties: list[str] | None = None, score: Column | None = None, i: str = "i") -> DataFrame:
    """Out-of-sample returns of the system that was best in each fold's training slice: all folds in one job.

    ``returns`` has a row a series, system and bar. ``score`` is an aggregate of
    a system's training rows, the mean of ``ret`` if left out; of equal ones the
    first by ``ties`` wins.
    """
    score = F.avg("ret") if score is None else score
    scored = training_folds(returns, n_train, n_test, warm, i).groupBy(*by, "fold", *keys).agg(score.alias("in_sample"))
    chosen = best(scored, "in_sample", ties or keys[::-1], [*by, "fold"], [*keys, "in_sample"])
    return test_folds(returns, n_train, n_test, i).join(chosen, [*by, "fold", *keys])


def breakout_walk_forward(rows: DataFrame, most: int, n_train: int, n_test: int, criterion: str = "mean", all_bars: bool = False, by: list[str] = ("symbol",), i: str = "i") -> DataFrame:
    """Breakout rows of each fold's test by the system that was best in its training slice.

    A fold starts out of the market at its first bar with all means, and the
    position at the end of training is carried into the test. ``criterion`` is one
    of CRITERIA, over all bars or over those in the market.
    """
    start = F.col("fold") * n_test + (most - 1)
    train = restarted(training_folds(rows.where("_next IS NOT NULL"), n_train, n_test, most - 1, i), start)
    traded = F.lit(True) if all_bars else F.col("pos") == 1
    scores = train.groupBy(*by, "fold", "look", "k").agg(*criteria(F.col("ret"), traded))
    chosen = best(scores, criterion, ["look", "k"], [*by, "fold"], ["look", "k", criterion]).withColumnRenamed(criterion, "in_sample")
    test = test_folds(rows.where("_next IS NOT NULL"), n_train, n_test, i).join(chosen, [*by, "fold", "look", "k"])
    return restarted(test, start)


def crunch(df: DataFrame, ret: str, order: str, size: int = 10, by: list[str] = ()) -> DataFrame:
    """Means of consecutive groups of returns."""
    place = Window.partitionBy(*by).orderBy(order)
    held = df.withColumn("_g", F.floor((F.row_number().over(place) - 1) / size))
    return held.groupBy(*by, F.col("_g").cast("long").alias("grp")).agg(F.avg(ret).alias("ret"))
