"""The tools: each takes bars (``symbol, i, x, lo, lh, ll, ...``) or only numbers and gives a table."""

from __future__ import annotations

import json
import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import dist, rng
from ..operators import backtest, grids, indicators as ind, market_models, models, optimize, recurrences, replicate, resample, stats
from ..operators.indicators import Series
from ..sources.scratch import kept

YEAR = 252 * 100


def entropy_report(bars: DataFrame, lookback: int = 10, bins: int = 10, version: int = 0) -> DataFrame:
    """Quantiles and relative entropy of trend, volatility, expansion, jump and tail-cleaned jump."""
    df = ind.with_true_range(bars, "lh", "ll", "x")
    made = {
        "trend": lambda n: ind.slope("x", n),
        "volatility": ind.atr_of,
        "expansion": lambda n: ind.range_expansion("x", n),
        "raw_jump": lambda n: ind.price_jump("x", n),
    }
    for name, make in made.items():
        df = ind.versions(df, name, make, lookback, version)
    held = df.select("symbol", "i", *made).dropna()
    clean = ind.clean_tails(held.select("symbol", "i", F.col("raw_jump").alias("v")), "v", 0.05).select("symbol", F.lit("cleaned_jump").alias("series"), F.col("cleaned").alias("value"))
    stack = ", ".join(f"'{n}', {n}" for n in made)
    long = held.select("symbol", F.expr(f"stack({len(made)}, {stack}) AS (series, value)")).unionByName(clean)
    keys = ["symbol", "series"]
    low = long.groupBy(*keys).agg(F.min("value").alias("low"), F.max("value").alias("high"), F.median("value").alias("median"))
    return low.join(stats.relative_entropy(long, "value", bins, keys), keys)


def stationarity_report(bars: DataFrame, lookback: int = 10, fractile: float = 0.5, version: int = 0) -> DataFrame:
    """Run lengths of trend and volatility at or above, and below, their own quantile."""
    df = ind.with_true_range(bars, "lh", "ll", "x")
    df = ind.versions(df, "trend", lambda n: ind.slope("x", n), lookback, version)
    df = ind.versions(df, "volatility", ind.atr_of, lookback, version)
    out = None
    for name in ("trend", "volatility"):
        part = df.select("symbol", "i", F.col(name).alias("v")).where("v IS NOT NULL")
        cut = part.groupBy("symbol").agg(stats.order_quantile("v", fractile).alias("cut"))
        found = ind.runs(part.join(cut, "symbol"), "v", F.col("cut")).withColumn("series", F.lit(name))
        out = found if out is None else out.unionByName(found)
    return out


def selection_report(bars: DataFrame, blocks: int = 10, most: int = 20) -> DataFrame:
    """Best criterion (x 1000) over all bars, and the chance that the best in-sample is mediocre out of it."""
    rows = grids.crossover_returns(bars, "x", most)
    found = resample.cscv(rows, blocks, most - 1)
    score = rows.groupBy("symbol", "short", "long").agg(F.avg("ret").alias("m")).groupBy("symbol").agg((F.max("m") * 1000).alias("best_x1000"))
    return found.join(score, "symbol")


def walk_forward_breakout(bars: DataFrame, most: int = 20, n_train: int = 400, n_test: int = 200, kind: int = 2, criterion: str = "mean", all_bars: bool = False, steps: int = 10) -> DataFrame:
    """Out-of-sample returns of the breakout system that was best by a criterion in each fold."""
    test = grids.breakout_walk_forward(grids.breakout(bars, "x", most, steps), most, n_train, n_test, criterion, all_bars)
    return grids.breakout_returns(test, kind, ["symbol", "fold"])


def performance_report(bars: DataFrame, kinds: tuple[int, ...] = (1, 2), all_bars: bool = False, **kw) -> DataFrame:
    """``symbol, criterion, kind``: yearly mean, profit factor and Sharpe ratio of the out-of-sample returns, for each criterion of choice and kind of return."""
    made = [
        walk_forward_breakout(bars, kind=kind, criterion=c, all_bars=all_bars, **kw).select("symbol", F.lit(c).alias("criterion"), F.lit(kind).alias("kind"), "ret")
        for c in grids.CRITERIA for kind in kinds
    ]
    held = reduce(DataFrame.unionByName, made).groupBy("symbol", "criterion", "kind").agg(*grids.criteria(F.col("ret"), F.lit(True)))
    return held.select("symbol", "criterion", "kind", F.col("n_bars").alias("n"), (F.col("mean") * YEAR).alias("mean_x25200"), "profit_factor", "sharpe")


def mean_bounds(bars: DataFrame, reps: int = 200, seed: int = 5, most: int = 12, n_train: int = 400, n_test: int = 200, steps: int = 10) -> DataFrame:
    """``symbol, kind``: lower 10 % bounds of the mean return by t, percentile, pivot and BCa, for three kinds of returns.

    The kinds are bars in the market, completed trades, and all bars in groups of
    ten. Series with fewer than three returns have no bound.
    """
    rows = {kind: walk_forward_breakout(bars, most, n_train, n_test, kind, steps=steps) for kind in (0, 1, 2)}
    order = Window.partitionBy("symbol").orderBy("fold", "i")
    kinds = {"open": rows[1], "complete": rows[2], "grouped": grids.crunch(rows[0], "ret", "i", 10, ["symbol"]).select("symbol", F.lit(0).alias("fold"), F.col("grp").alias("i"), "ret")}
    made = [df.select("symbol", F.lit(name).alias("kind"), "ret", (F.row_number().over(order) - 1).alias("i")) for name, df in kinds.items()]
    keys = ["symbol", "kind"]
    held = reduce(DataFrame.unionByName, made).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*keys))).where("_n > 2").drop("_n").persist()
    draws = resample.bootstrap(held, "ret", keys, reps, seed, F.avg("ret"))
    pct = resample.bounds(draws, (0.10,), keys).select(*keys, F.col("low").alias("percentile"), "high")
    bca = resample.bca_of_mean(held, "ret", draws, (0.10,), keys).select(*keys, F.col("low").alias("bca"))
    base = stats.t_summary(held, "ret", keys).select(*keys, "n", "mean", F.col("lower").alias("t_bound"))
    return base.join(pct, keys).join(bca, keys).select(*keys, "n", "mean", "t_bound", "percentile", (F.col("mean") * 2 - F.col("high")).alias("pivot"), "bca")


def fold_returns(bars: DataFrame, most: int = 10, n_train: int = 400, n_test: int = 100) -> DataFrame:
    """``symbol, fold, ret``: each fold's mean out-of-sample return of the crossover that was best in it, times 25,200.

    A system's first bar is the first with its own long mean, and its training total is divided by the prices from there on.
    """
    rows = grids.crossover_returns(bars, "x", most, own_start=True, exclusive=True)
    score = F.sum("ret") / (F.lit(n_train) - F.max("long"))
    out = grids.walk_forward(rows, n_train, n_test, ["short", "long"], ["symbol"], F.col("long") - 1, score=score)
    return out.groupBy("symbol", "fold").agg((F.avg("ret") * YEAR).alias("ret"))


def return_bounds(bars: DataFrame, most: int = 10, n_train: int = 400, n_test: int = 100, lower: float = 0.1, upper: float = 0.1, p_of_q: float = 0.05) -> DataFrame:
    """``symbol, side``: order-statistic bounds of the folds' mean returns, and how far their failure rates may be off.

    ``optimistic`` is the chance that the true failure rate is at most 0.9 times
    the wanted one, ``pessimistic`` that it is at least 1.1 times; ``low_q`` and
    ``high_q`` are the rates that it is below, or above, with chance ``p_of_q``.
    """
    held = fold_returns(bars, most, n_train, n_test).groupBy("symbol").agg(F.array_sort(F.collect_list("ret")).alias("s"))
    n = F.size("s")
    place = lambda rate: F.greatest(F.floor(F.lit(rate) * (n + 1)).cast("int"), F.lit(1))
    side = lambda name, rate, at: F.struct(F.lit(name).alias("side"), F.lit(rate).alias("rate"), place(rate).alias("m"), F.element_at("s", at).alias("bound"))
    sides = F.explode(F.array(side("lower", lower, place(lower)), side("upper", upper, n + 1 - place(upper)))).alias("_b")
    held = held.select("symbol", n.alias("n"), sides).select("symbol", "n", "_b.*")
    nn, m, rate = F.col("n").cast("double"), F.col("m").cast("double"), F.col("rate")
    held = held.withColumn("optimistic", 1 - dist.order_tail(nn, rate * 0.9, m)).withColumn("pessimistic", dist.order_tail(nn, rate * 1.1, m))
    return held.withColumn("low_q", dist.quantile_confidence(nn, m, F.lit(p_of_q))).withColumn("high_q", dist.quantile_confidence(nn, m, F.lit(1 - p_of_q))).drop("rate")


#: The statistics whose bounds ``coverage_study`` tests: aggregates over a column of returns.
def log_profit_factor(r: Column) -> Column:
    return F.log((F.sum(F.greatest(r, F.lit(0.0))) + 1e-10) / (F.sum(F.greatest(-r, F.lit(0.0))) + 1e-10))


def sharpe_ratio(r: Column) -> Column:
    sd = F.stddev_pop(r)
    return F.when(sd > 0, F.avg(r) / sd).otherwise(F.lit(1e30))


def steps_of(n: int) -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))


def coverage_study(spark: SparkSession, samples: int = 30, reps: int = 50, tries: int = 40, prob: float = 0.6, seed: int = 9) -> DataFrame:
    """``statistic, method, level, low, high``: how often percentile, BCa and pivot bounds miss the true value on either side.

    Trades win with chance ``prob`` and are 0.01 + 0.002 z large; the statistics
    are the log profit factor, whose true value is known, and the Sharpe ratio,
    which is that of all trades together. Tries are keys, all in one job.
    """
    data = spark.range(tries).select(F.col("id").alias("try"), steps_of(samples).alias("i"))
    size = rng.normal(seed + 3, "try", "i") * 0.002 + 0.01
    data = data.withColumn("r", F.when(rng.uniform(seed, "try", "i") <= prob, size).otherwise(-size))
    picks = spark.range(tries).select(F.col("id").alias("try"), steps_of(reps).alias("rep")).select("*", steps_of(samples).alias("j"))
    picks = picks.withColumn("i", (rng.bits(seed + 7, "try", "rep", "j") % samples).cast("int"))
    drawn = picks.join(data, ["try", "i"])
    left_out = data.select("try", F.col("i").alias("out")).join(data, "try").where("i <> out")  # samples x samples rows a try
    whole = data.agg(sharpe_ratio(F.col("r")).alias("sharpe")).withColumn("log_pf", F.lit(math.log(prob / (1 - prob))))
    out = None
    for name, stat in (("log_pf", log_profit_factor), ("sharpe", sharpe_ratio)):
        stats_of = drawn.groupBy("try", "rep").agg(stat(F.col("r")).alias("stat")).groupBy("try").agg(F.array_sort(F.collect_list("stat")).alias("s"))
        accel = resample.acceleration(left_out.groupBy("try", "out").agg(stat(F.col("r")).alias("_j")), "_j", ["try"])
        held = stats_of.join(data.groupBy("try").agg(stat(F.col("r")).alias("theta")), "try").join(accel, "try")
        held = held.select("*", F.explode(F.array(*[F.lit(p) for p in (0.025, 0.05, 0.10)])).alias("prob"))
        low, high = resample.percentile(F.col("s"), F.col("prob"))
        pct = held.select("prob", low.alias("low"), high.alias("high"), "theta")
        made = pct.select(F.lit("percentile").alias("method"), "prob", "low", "high")
        made = made.unionByName(pct.select(F.lit("pivot").alias("method"), "prob", (F.col("theta") * 2 - F.col("high")).alias("low"), (F.col("theta") * 2 - F.col("low")).alias("high")))
        made = made.unionByName(resample.bca(held, ["prob"]).withColumn("method", F.lit("bca")))
        missed = made.join(F.broadcast(whole.select(F.col(name).alias("truth"))), F.lit(True)).groupBy("method", F.col("prob").alias("level")).agg(
            F.avg((F.col("low") > F.col("truth")).cast("double")).alias("low"), F.avg((F.col("high") < F.col("truth")).cast("double")).alias("high")
        )
        part = missed.select(F.lit(name).alias("statistic"), "method", "level", "low", "high")
        out = part if out is None else out.unionByName(part)
    return out


RATES = (0.001, 0.01, 0.05, 0.1)


def drawdown_study(
    spark: SparkSession, n_changes: int = 40, n_trades: int = 20, win: float = 0.6, reps: int = 20, inner: int = 20, tests: int = 10, paths: int = 50, conf: float = 0.8, seed: int = 21
) -> DataFrame:
    """``rate, mean_worse, drawdown_worse, bounded_worse``: how often later trades are worse than bounds from one sample of changes.

    For each test the simple bounds are quantiles of the mean return and of the
    drawdown over resamples of the sample. The bound on a bound takes resamples
    of the sample, the drawdown quantiles over ``inner`` resamples of each, and of
    these the quantile at ``conf`` (halfway to 1 for the two rarest rates). Fresh
    trades, ``paths`` of them a test, are held against all.
    """
    signed = lambda seed, *k: F.when(rng.uniform(seed, *k) < win, F.lit(1.0)).otherwise(F.lit(-1.0)) * F.abs(rng.normal(seed + 2, *k))
    tries = spark.range(tests).select(F.col("id").alias("try"))
    sample = tries.select("try", steps_of(n_changes).alias("i")).withColumn("r", signed(seed, "try", "i"))
    pick = lambda n, seed, *k: (rng.bits(seed, *k) % n).cast("int")
    once = tries.select("try", steps_of(reps).alias("rep")).select("*", steps_of(n_trades).alias("j")).withColumn("i", pick(n_changes, seed + 5, "try", "rep", "j")).join(sample, ["try", "i"])
    means = once.groupBy("try", "rep").agg(F.avg("r").alias("m")).groupBy("try").agg(*[stats.order_quantile("m", p).alias(f"m{k}") for k, p in enumerate(RATES)])
    falls = resample.worst_drawdowns(once, "r", ["try", "rep"]).groupBy("try").agg(*[stats.order_quantile("dd", 1 - p).alias(f"d{k}") for k, p in enumerate(RATES)])
    again = tries.select("try", steps_of(reps).alias("rep")).select("*", steps_of(n_changes).alias("j")).withColumn("i", pick(n_changes, seed + 6, "try", "rep", "j"))
    again = again.join(sample, ["try", "i"]).select("try", "rep", F.col("j").alias("i"), "r")
    nested = tries.select("try", steps_of(reps).alias("rep")).select("*", steps_of(inner).alias("b")).select("*", steps_of(n_trades).alias("j"))
    nested = nested.withColumn("i", pick(n_changes, seed + 7, "try", "rep", "b", "j")).join(again, ["try", "rep", "i"])
    inner_q = resample.worst_drawdowns(nested, "r", ["try", "rep", "b"]).groupBy("try", "rep").agg(*[stats.order_quantile("dd", 1 - p).alias(f"q{k}") for k, p in enumerate(RATES)])
    levels = [1 - (1 - conf) / 2, 1 - (1 - conf) / 2, conf, conf]
    outer = inner_q.groupBy("try").agg(*[stats.order_quantile(f"q{k}", p).alias(f"b{k}") for k, p in enumerate(levels)])
    fresh = tries.select("try", steps_of(paths).alias("path")).select("*", steps_of(n_trades).alias("j")).withColumn("r", signed(seed + 8, "try", "path", "j"))
    seen = resample.worst_drawdowns(fresh, "r", ["try", "path"]).join(fresh.groupBy("try", "path").agg(F.avg("r").alias("mean")), ["try", "path"])
    held = seen.join(means, "try").join(falls, "try").join(outer, "try")
    rows = F.explode(F.array(*[F.struct(F.lit(p).alias("rate"), F.col(f"m{k}").alias("m"), F.col(f"d{k}").alias("d"), F.col(f"b{k}").alias("b")) for k, p in enumerate(RATES)])).alias("_r")
    share = lambda c: F.avg(c.cast("double"))
    return held.select("mean", "dd", rows).select("mean", "dd", "_r.*").groupBy("rate").agg(
        share(F.col("mean") < F.col("m")).alias("mean_worse"), share(F.col("dd") > F.col("d")).alias("drawdown_worse"), share(F.col("dd") > F.col("b")).alias("bounded_worse")
    )


def order_statistic_check(spark: SparkSession, samples: int = 100, rate: float = 0.1, low_q: float = 0.0975, high_q: float = 0.101, tries: int = 400, seed: int = 31) -> DataFrame:
    """Observed failure rates of order-statistic bounds of uniform samples beside theory."""
    m = max(1, int(rate * (samples + 1)))
    data = spark.range(tries).select(F.col("id").alias("try"), F.explode(F.sequence(F.lit(0), F.lit(samples - 1))).alias("i")).withColumn("u", rng.uniform(seed, "try", "i"))
    bound = data.groupBy("try").agg(F.element_at(F.array_sort(F.collect_list("u")), m).alias("b"))
    found = bound.agg(F.avg((F.col("b") < low_q).cast("double")).alias("below_low"), F.avg((F.col("b") > high_q).cast("double")).alias("above_high"), F.avg("b").alias("mean_rate"))
    n, mm = F.lit(float(samples)), F.lit(float(m))
    return found.withColumn("theory_low", dist.order_tail(n, F.lit(low_q), mm)).withColumn("theory_high", 1 - dist.order_tail(n, F.lit(high_q), mm))


def random_walks(spark: SparkSession, reps: int, n: int, trend: float = 0.0, seed: int = 41, phase: int = 0) -> DataFrame:
    """``rep, i, x``: walks from 0 whose steps are two uniforms less two others, plus a drift that changes sign every 50 bars.

    The sign first changes at the bar 50 - ``phase``.
    """
    held = spark.range(reps).select(F.col("id").cast("int").alias("rep"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i"))
    drift = F.when(F.floor((F.col("i") + phase) / 50) % 2 == 0, F.lit(trend)).otherwise(F.lit(-trend))
    u = [rng.uniform(seed + k, "rep", "i") for k in range(4)]
    held = held.withColumn("_s", F.when(F.col("i") == 0, F.lit(0.0)).otherwise(drift + u[0] + u[1] - u[2] - u[3]))
    upto = Window.partitionBy("rep").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    return held.select("rep", "i", F.sum("_s").over(upto).alias("x"))


REPS = Series(("rep",), "i")


def training_bias(spark: SparkSession, reps: int = 10, n: int = 200, trend: float = 0.0, most: int = 10, criterion: str = "mean", side: str = "both", seed: int = 41) -> DataFrame:
    """``rep, short, long, in_sample, out_of_sample, bias``: mean returns of the crossover that is best by ``criterion`` on a walk, and of the same on a fresh one."""

    def grid(which: int) -> DataFrame:
        return grids.crossover_grid(random_walks(spark, reps, n, trend, which), "x", most, side, REPS, own_start=True)

    keep = list(dict.fromkeys(["short", "long", "mean"]))
    best = grids.best(grid(seed), criterion, ["long", "short"], ["rep"], keep).withColumnRenamed("mean", "in_sample")
    out = grid(seed + 500).select("rep", "short", "long", F.col("mean").alias("out_of_sample"))
    return best.join(out, ["rep", "short", "long"]).withColumn("bias", F.col("in_sample") - F.col("out_of_sample"))


def selection_bias(spark: SparkSession, reps: int = 10, n: int = 200, trend: float = 0.0, most: int = 10, criterion: str = "mean", seed: int = 61) -> DataFrame:
    """``rep, long_bias, short_bias, side, oos1, oos2, bias``: the long-only or the short-only system is chosen on a second walk and judged on a third.

    Each system is the crossover that is best by ``criterion`` on the first walk;
    its training bias is its mean there less that on the second. The long system
    is chosen if it did better there.
    """
    sides = []
    for side in ("long", "short"):
        grid = lambda which, side=side: grids.crossover_grid(random_walks(spark, reps, n, trend, which, 1), "x", most, side, REPS, own_start=True)
        top = grids.best(grid(seed), criterion, ["long", "short"], ["rep"], ["short", "long", "mean"]).withColumnRenamed("mean", f"{side}_is")
        second = grid(seed + 500).select("rep", "short", "long", F.col("mean").alias(f"{side}_1"))
        third = grid(seed + 900).select("rep", "short", "long", F.col("mean").alias(f"{side}_2"))
        sides.append(top.join(second, ["rep", "short", "long"]).join(third, ["rep", "short", "long"]).select("rep", f"{side}_is", f"{side}_1", f"{side}_2"))
    both = sides[0].join(sides[1], "rep")
    long = F.col("long_1") > F.col("short_1")
    pick = lambda k: F.when(long, F.col(f"long_{k}")).otherwise(F.col(f"short_{k}"))
    return both.select(
        "rep", (F.col("long_is") - F.col("long_1")).alias("long_bias"), (F.col("short_is") - F.col("short_1")).alias("short_bias"),
        F.when(long, F.lit("long")).otherwise(F.lit("short")).alias("side"), pick(1).alias("oos1"), pick(2).alias("oos2"), (pick(1) - pick(2)).alias("bias"),
    )


def cases_of(walk: DataFrame, lookback: int, ahead: int) -> DataFrame:
    """``rep, k, a, b``: indicator and target of each bar that has both, numbered from 0."""
    held = walk.withColumn("a", ind.slope("x", lookback, REPS) * (lookback - 1) / 2).withColumn("b", ind.targets("x", ahead, REPS)).dropna(subset=["a", "b"])
    return held.select("rep", (F.col("i") - (lookback - 1)).alias("k"), "a", "b")


def walked(cases: DataFrame, n: int, n_train: int, n_test: int, omit: int, extra: int = 0) -> DataFrame:
    """``rep, r``: out-of-sample returns of a regression that is fitted anew in each fold, on all its cases but the last ``omit``."""
    table = F.broadcast(cases.sparkSession.createDataFrame(grids.folds(n, n_train, n_test, extra=extra), "fold int, first int, test int, last int"))
    k = F.col("k")
    fit = stats.regression(cases.join(table, (k >= F.col("first")) & (k < F.col("test") - omit)), "a", "b", ["rep", "fold"])
    return predicted_returns(cases.join(table, (k >= F.col("test")) & (k < F.col("last"))).join(fit, ["rep", "fold"]))


def predicted_returns(test: DataFrame) -> DataFrame:
    """The target where the prediction is above 0, else its negative."""
    return test.select("rep", F.when(F.col("a") * F.col("beta") + F.col("constant") > 0, F.col("b")).otherwise(-F.col("b")).alias("r"))


def overlap_study(spark: SparkSession, reps: int = 9, n: int = 600, lookback: int = 20, ahead: int = 10, n_train: int = 100, n_test: int = 20, omit: int = 0, extra: int = 0, seed: int = 71) -> DataFrame:
    """``rep, n, mean, sd, t, p, median_t, share``: t of walk-forward predictions on pure noise.

    Overlap of training targets with the test inflates t unless cases are omitted.
    The number of walks is made odd; ``median_t`` and ``share`` (of p at 0.1 or less) are those of all walks.
    """
    reps = reps // 2 * 2 + 1
    cases = cases_of(random_walks(spark, reps, n, 0.0, seed), lookback, ahead)
    held = walked(cases, n - lookback - ahead + 1, n_train, n_test, omit, extra).groupBy("rep").agg(
        F.count(F.lit(1)).alias("n"), F.avg("r").alias("mean"), F.sqrt(F.greatest(F.var_pop("r"), F.lit(1e-20))).alias("sd")
    )
    held = held.withColumn("t", F.sqrt(F.col("n")) * F.col("mean") / F.col("sd")).withColumn("p", 1 - F.expr(dist.normal_cdf_sql("t")))
    total = held.agg(F.element_at(F.array_sort(F.collect_list("t")), reps // 2 + 1).alias("median_t"), F.avg((F.col("p") <= 0.1).cast("double")).alias("share"))
    return held.join(F.broadcast(total), F.lit(True))


def even_cuts(n: int, parts: int) -> list[tuple[int, int, int]]:
    """(part, start, end): each takes the whole share of what the parts before it left."""
    out, at = [], 0
    for k in range(min(parts, n)):
        size = (n - at) // (min(parts, n) - k)
        out.append((k, at, at + size))
        at += size
    return out


def validation_study(spark: SparkSession, reps: int = 5, n: int = 400, lookback: int = 20, ahead: int = 5, folds: int = 5, omit: int = 5, n_train: int = 100, n_test: int = 50, trend: float = 0.0, seed: int = 81) -> DataFrame:
    """``rep, method, n, mean``: k-fold against walk-forward on the same walks; cases within ``omit`` of a test are not trained on."""
    cases = cases_of(random_walks(spark, reps, n, trend, seed, 1), lookback, ahead)
    size = n - lookback - ahead + 1
    cut = F.broadcast(spark.createDataFrame(even_cuts(size, folds), "fold int, a0 int, b0 int"))
    k = F.col("k")
    fit = stats.regression(cases.join(cut, (k < F.col("a0") - omit) | (k >= F.col("b0") + omit)), "a", "b", ["rep", "fold"])
    xval = predicted_returns(cases.join(cut, (k >= F.col("a0")) & (k < F.col("b0"))).join(fit, ["rep", "fold"])).withColumn("method", F.lit("xval"))
    both = xval.unionByName(walked(cases, size, n_train, n_test, omit).withColumn("method", F.lit("walk")))
    return both.groupBy("rep", "method").agg(F.count(F.lit(1)).alias("n"), F.avg("r").alias("mean"))


def features_of(bars: DataFrame, increment: int = 2, n_long: int = 3, n_short: int = 2, ahead: int = 1, rsi_periods: tuple[int, ...] = ()) -> tuple[DataFrame, list[str]]:
    """(bars with crossover features and target, feature names).

    ``rsi_periods`` adds an EMA-smoothed RSI of each period, from the first bar on
    that has all features; before it they are null.
    """
    names, columns = [], []
    for a in range(n_long):
        for b in range(n_short):
            long = (a + 1) * increment
            short = max(1, long * (b + 1) // (n_short + 1))
            name = f"f{short}_{long}_{a}{b}"
            names.append(name)
            columns.append(ind.ma_cross("x", short, long).alias(name) if short < long else (F.col("x") * 0).alias(name))
    held = bars.select("symbol", "i", "x", *columns, ind.targets("x", ahead).alias("target"))
    if rsi_periods:
        start = max([n_long * increment - 1, *rsi_periods])
        made = {f"rsi{n}": (lambda v, n=n: recurrences.rsi_ema_values(v, n, start)) for n in rsi_periods}
        rsi = recurrences.per_series(bars, made).select("symbol", "i", *[F.when(F.col("i") >= start, F.col(n)).alias(n) for n in made])
        names += list(made)
        held = held.join(rsi, ["symbol", "i"]).select("symbol", "i", "x", *names, "target")
    return held, names


def elastic_net(bars: DataFrame, symbol: str, n_test: int = 252, n_folds: int = 10, alpha: float = 0.5, **kw) -> tuple[models.Model, DataFrame, list[str]]:
    """(model fitted on all but the last bars, all bars with their prediction, feature names)."""
    df, names = features_of(bars.where(F.col("symbol") == symbol), **kw)
    last = df.agg(F.max("i")).first()[0]
    edge = (last or 0) + 1 - n_test
    train = df.where(F.col("i") < edge).dropna().withColumn("block", F.least(F.floor(F.col("i") * n_folds / edge), F.lit(n_folds - 1)).cast("int"))
    model = models.fit(train, names, "target", alpha, "block")
    scored = df.withColumn("pred", backtest.predicted(F.array(*names), vars(model))).withColumn("test", F.col("i") >= edge)
    return model, scored, names


def split_folds(df: DataFrame, n_test: int, n_folds: int) -> DataFrame:
    """``df`` with ``test`` (the last bars of each market) and ``block``, the fold of the others."""
    edge = F.max("i").over(Window.partitionBy("symbol")) + 1 - n_test
    held = df.withColumn("_edge", edge).withColumn("test", F.col("i") >= F.col("_edge"))
    return held.withColumn("block", F.least(F.floor(F.col("i") * n_folds / F.col("_edge")), F.lit(n_folds - 1)).cast("int")).drop("_edge")


def market_nets(df: DataFrame, names: list[str], n_test: int = 252, n_folds: int = 10, alpha: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """(the model of each market, fitted on all but its last bars; all bars with their prediction), all markets in one aggregate."""
    held = split_folds(df, n_test, n_folds)
    found = kept(market_models.fitted(held.where("NOT test"), names, "target", alpha, "symbol", F.col("block")), "models")
    return found, market_models.predicted(held.drop("block"), found, names)


def penalty_table(df: DataFrame, names: list[str], n_test: int = 252, n_folds: int = 10, alpha: float = 0.5, steps: int = 50) -> DataFrame:
    """``symbol, lam, explained, chosen``: what cross-validation over the training bars finds of each penalty, and which it takes, of every market."""
    held = split_folds(df, n_test, n_folds)
    return market_models.penalties(held.where("NOT test"), names, "target", alpha, "symbol", F.col("block"), steps)


def combined_features(bars: DataFrame, types: tuple[str, ...] = ("ma", "rsi", "ema", "macd", "roc"), increment: int = 4, n_long: int = 2, n_short: int = 1, ahead: int = 1) -> tuple[DataFrame, list[str], list[dict]]:
    """(bars with a feature for each type and pair of lookbacks, and their target; the features' names; their specs).

    The specs run through the types first, then the long and the short lookbacks.
    """
    pairs = [((a + 1) * increment, max(1, (a + 1) * increment * (b + 1) // (n_short + 1))) for a in range(n_long) for b in range(n_short)]
    held = bars.select("symbol", "i", "x", ind.targets("x", ahead).alias("target"))
    specs = [{"type": t, "short_lookback": short, "long_lookback": long} for t in types for long, short in pairs]
    name = lambda s: f"{s['type']}_{s['short_lookback']}_{s['long_lookback']}"
    for long, short in dict.fromkeys(pairs):
        made = recurrences.crossovers(bars.select("symbol", "i", "x"), short, long)
        held = held.join(made.select("symbol", "i", *[F.col(t).alias(f"{t}_{short}_{long}") for t in types]), ["symbol", "i"])
    return held, [name(s) for s in specs], specs


def combined_model(bars: DataFrame, symbol: str, n_test: int = 252, n_folds: int = 10, alpha: float = 0.5, **kw) -> tuple[str, DataFrame]:
    """(the saved model as JSON, its predictions of the last ``n_test`` bars) of an elastic net over the crossover family of one market.

    The JSON holds the model, the specs of its features and the settings, so that ``model_predictions`` can apply it to other bars.
    """
    df, names, specs = combined_features(bars.where(F.col("symbol") == symbol), **kw)
    df = df.persist()  # one market's features, read by the pivots, the sums and the predictions
    last = df.agg(F.max("i")).first()[0]
    edge = (last or 0) + 1 - n_test
    train = df.where(F.col("i") < edge).dropna().withColumn("block", F.least(F.floor(F.col("i") * n_folds / edge), F.lit(n_folds - 1)).cast("int"))
    model = models.fit(train, names, "target", alpha, "block")
    saved = json.dumps({"model": json.loads(model.to_json()), "specs": specs, "config": {"n_test": n_test, "n_folds": n_folds, "alpha": alpha, **kw}})
    return saved, df.where(F.col("i") >= edge).withColumn("pred", backtest.predicted(F.array(*names), vars(model)))


def combined_models(bars: DataFrame, n_test: int = 252, n_folds: int = 10, alpha: float = 0.5, **kw) -> DataFrame:
    """``symbol, i, target, pred, model``: what ``combined_model`` gives, of every market in one aggregate."""
    df, names, specs = combined_features(bars, **kw)
    df = kept(df, "features")
    found, scored = market_nets(df, names, n_test, n_folds, alpha)
    parts = [c.split()[0] for c in market_models.MODEL.split(", ")]
    rest = json.dumps({"specs": specs, "config": {"n_test": n_test, "n_folds": n_folds, "alpha": alpha, **kw}})
    # one object: the model's, then the specs and the settings
    saved = F.concat(F.lit('{"model": '), F.to_json(F.struct(*parts)), F.lit(", " + rest[1:]))
    both = scored.where("test").dropna(subset=[*names, "target"]).join(found.select(F.col("symbol").alias("_s"), saved.alias("model")), F.col("symbol") == F.col("_s"))
    return both.select("symbol", "i", "target", "pred", "model")


def model_predictions(bars: DataFrame, saved: str) -> DataFrame:
    """``symbol, i, pred`` of a saved model for all bars that have its features."""
    held = json.loads(saved)
    kw = {k: v for k, v in held["config"].items() if k in ("types", "increment", "n_long", "n_short", "ahead")}
    df, names, specs = combined_features(bars, **kw)
    if specs != held["specs"]:
        raise ValueError("the settings do not give the saved features")
    return df.dropna(subset=names).select("symbol", "i", backtest.predicted(F.array(*names), held["model"]).alias("pred"))


def evolved_systems(bars: DataFrame, most: int = 30, population: int = 20, generations: int = 6, least: int = 5, seed: int = 3) -> dict[str, tuple]:
    """(best parameters, their return, sensitivity curves) of the threshold system on each market; a generation of all markets is one job."""
    bounds = optimize.Bounds((2.0, 0.01, 0.0, 0.0), (float(most), 99.0, 300.0, 300.0), 1)
    systems = optimize.ThresholdSystems(bars, most, least)

    def study(symbol: str) -> optimize.Search:
        search = optimize.evolution(bounds, population, generations, seed=seed, relax=lambda: systems.relax(symbol))
        best, value, _ = yield from optimize.shifted(search, 10.0)  # criteria must be positive
        return best, value - 10.0, (yield from optimize.curves(best, bounds, 8))

    return optimize.in_step(systems, {x: study(x) for x in systems.symbols})


def report(bars: DataFrame, symbol: str) -> str:
    """The whole study of one market as text: indicators, model, permutation test, selection, backtest."""
    one = bars.where(F.col("symbol") == symbol).persist()
    n = one.count()
    parts = [f"# {symbol}: {n} bars"]
    table = lambda title, df: parts.append(f"\n## {title}\n" + "\n".join(str(r.asDict()) for r in df.collect()))
    table("Indicators", entropy_report(one))
    table("Runs", stationarity_report(one))
    model, scored, _ = elastic_net(one, symbol)
    parts.append(f"\n## Model\n{model.to_json()}")
    table("Out of sample", backtest.out_of_sample(scored.where("test AND pred IS NOT NULL AND target IS NOT NULL"), "pred", "target"))
    table("Permutation test", resample.mcpt_trend(one, 12, 10, 11))
    table("Selection", selection_report(one, 6, 12))
    signals = grids.threshold_signals(one, 20, 40.0, 8.0, 8.0, exclude_current=True)
    table("Backtest", backtest.summary(signals, 10_000.0, 0.1))
    one.unpersist()
    return "\n".join(parts)


def aligned(bars: DataFrame) -> DataFrame:
    """Bars of the days that every market has, on one time axis."""
    markets = bars.select("symbol").distinct().count()
    days = bars.groupBy("dt").agg(F.count(F.lit(1)).alias("_k")).where(F.col("_k") == markets).select("dt")
    held = bars.drop("i").join(days, "dt", "left_semi")
    return held.withColumn("i", F.row_number().over(Window.partitionBy("symbol").orderBy("dt")) - 1)


def chooser_report(bars: DataFrame, window: int, out_window: int, reps: int = 10, seed: int = 93) -> DataFrame:
    """``criterion, mean_x25200, p, chosen``: each criterion's and the final system's yearly return, its chance under shuffling, and the share of times it was chosen.

    Replications shuffle all markets' changes in one order within three segments:
    the first window, the bars that rank the criteria, and the rest. p counts the data
    itself as one replication. ``bars`` must be aligned.
    """
    markets = bars.select("symbol", "i", "x")
    shuffled = resample.permuted(markets, reps, seed, 0, joint=True, cuts=(window, window + out_window))
    picks = resample.criterion_picks(shuffled, window, keys=("rep",))
    final = resample.final_picks(picks, out_window, keys=("rep",))
    tested = picks.where(F.col("i") >= window + out_window - 1)
    value = (F.avg("ret") * YEAR).alias("v")
    made = tested.groupBy("rep", F.element_at(F.array(*map(F.lit, resample.CHOICES)), F.col("criterion") + 1).alias("criterion")).agg(value)
    made = made.unionByName(final.groupBy("rep").agg(value).select("rep", F.lit("final").alias("criterion"), "v"))
    base = made.where("rep = 0").select("criterion", F.col("v").alias("mean_x25200"))
    held = made.join(base, "criterion").groupBy("criterion", "mean_x25200").agg(F.avg((F.round("v", 9) >= F.round("mean_x25200", 9)).cast("double")).alias("p"))
    names = F.element_at(F.array(*map(F.lit, resample.CHOICES)), F.col("criterion") + 1)
    counts = final.where("rep = 0").groupBy(names.alias("criterion")).agg(F.count(F.lit(1)).alias("_c"))
    total = counts.agg(F.sum("_c").alias("_all"))
    shares = counts.join(F.broadcast(total), F.lit(True)).select("criterion", (F.col("_c") / F.col("_all")).alias("chosen"))
    return held.join(shares, "criterion", "left").withColumn("chosen", F.when(F.col("criterion") != "final", F.coalesce("chosen", F.lit(0.0))))


#: Confidences of the bounds on drawdown quantiles.
CONFIDENCES = (0.5, 0.6, 0.7, 0.8, 0.9, 0.95)


def chooser_bounds(bars: DataFrame, window: int, out_window: int, reps: int = 20, inner: int = 20, size: int = 40, seed: int = 91, hashed: bool = True) -> DataFrame:
    """``prob, confidence, bound``: bounds on the quantiles of a year's worst drawdown, in percent, of the chooser's returns.

    The returns are resampled, and the drawdown quantiles of each resample come
    from ``inner`` paths of ``size`` returns drawn from it; a bound is the
    quantile of these over the resamples. ``bars`` must be aligned. ``hashed``
    draws are the same on any engine; others are faster.
    """
    order = Window.partitionBy("one").orderBy("i")  # one series of bars
    held = resample.chooser(bars, window, out_window).select(F.lit(1).alias("one"), "i", "ret").select("ret", (F.row_number().over(order) - 1).alias("i"))
    each = replicate.nested_drawdowns(held, "ret", "i", reps, inner, size, seed, (0.999, 0.99, 0.95, 0.90), hashed)
    found = each.groupBy("prob").agg(F.array(*[F.struct(F.lit(c).alias("confidence"), stats.order_quantile("drawdown", c).alias("bound")) for c in CONFIDENCES]).alias("_b"))
    return found.select("prob", F.explode("_b").alias("_b")).select("prob", "_b.*")
