"""Bootstrap, permutation and bias estimates with draws that are hashes of (seed, replication, place)."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import dist, rng
from . import grids, replicate
from .indicators import MARKET, Series
from .stats import order_quantile


def draws(df: DataFrame, by: list[str], reps: int, seed: int, size: int | None = None) -> DataFrame:
    """``by, rep, j, i``: for each series and replication, places drawn with replacement from 0 to n-1, as many or ``size``.

    Series of equal length draw the same places, as hashes of (seed, replication, j).
    """
    held = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).select(*by, "_n", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))).alias("rep"))
    held = held.select("*", F.explode(F.sequence(F.lit(0), (F.col("_n") if size is None else F.lit(size)).cast("int") - 1)).alias("j"))
    return held.withColumn("i", (rng.bits(seed, "rep", "j") % F.col("_n")).cast("int")).drop("_n")


def bootstrap(df: DataFrame, x: str, by: list[str], reps: int, seed: int, stat: Column, i: str = "i") -> DataFrame:
    """``by, rep, stat`` of each resample of each series (``i`` from 0 to n-1)."""
    held = draws(df, by, reps, seed).join(df.select(*by, i, x), [*by, i])
    return held.groupBy(*by, "rep").agg(stat.alias("stat"))


def percentile(sorted_stats: Column, prob: Column) -> tuple[Column, Column]:
    """The k-th statistic from either end, k = floor(p (B + 1)), 1 at least."""
    k = F.greatest(F.floor(prob * (F.size(sorted_stats) + 1)).cast("int"), F.lit(1))
    return F.element_at(sorted_stats, k), F.element_at(sorted_stats, F.size(sorted_stats) + 1 - k)


def bounds(stats: DataFrame, probs: tuple[float, ...] = (0.025, 0.05, 0.10), by: list[str] = ()) -> DataFrame:
    """``by, prob, low, high`` by the percentile rule."""
    held = stats.groupBy(*by).agg(F.array_sort(F.collect_list("stat")).alias("s"))
    held = held.select(*by, "s", F.explode(F.array(*[F.lit(p) for p in probs])).alias("prob"))
    low, high = percentile(F.col("s"), F.col("prob"))
    return held.select(*by, "prob", low.alias("low"), high.alias("high"))


def pivot(found: DataFrame, estimate: Column, by: list[str] = ()) -> DataFrame:
    """The pivot interval: percentile bounds mirrored at the estimate."""
    return found.select(*by, "prob", (estimate * 2 - F.col("high")).alias("low"), (estimate * 2 - F.col("low")).alias("high"))


def bca(held: DataFrame, keep: list[str]) -> DataFrame:
    """``keep, low, high``: BCa bounds of any statistic, from rows of ``s`` (sorted resamples), ``theta``, ``accel`` and ``prob``.

    The bias comes from the share of resamples below the estimate.
    """
    size = F.size("s")
    below = F.size(F.filter("s", lambda v: v < F.col("theta")))
    held = held.withColumn("share", F.greatest(F.least(below, size - 1), F.lit(1)) / size).withColumn("z0", F.expr(dist.inverse_normal_sql("share")))
    for name, p in (("zl", "prob"), ("zh", "(1.0E0 - prob)")):
        held = held.withColumn(name, F.expr(dist.inverse_normal_sql(p)))
    for name, z in (("al", "zl"), ("ah", "zh")):
        adj = F.col("z0") + (F.col("z0") + F.col(z)) / (1 - F.col("accel") * (F.col("z0") + F.col(z)))
        held = held.withColumn("_a", adj).withColumn(name, F.expr(dist.normal_cdf_sql("_a"))).drop("_a")
    low = F.greatest(F.floor(F.col("al") * (size + 1)).cast("int"), F.lit(1))
    high = F.greatest(F.floor((1 - F.col("ah")) * (size + 1)).cast("int"), F.lit(1))
    return held.select(*keep, F.element_at("s", F.least(low, size)).alias("low"), F.element_at("s", F.greatest(size + 1 - high, F.lit(1))).alias("high"))


def acceleration(left_out: DataFrame, value: str, by: list[str]) -> DataFrame:
    """``by, accel`` from leave-one-out statistics."""
    mean = left_out.groupBy(*by).agg(F.avg(value).alias("_m"))
    held = left_out.join(mean, list(by))
    dev = F.col("_m") - F.col(value)
    return held.groupBy(*by).agg((F.sum(dev * dev * dev) / (F.pow(F.sqrt(F.sum(dev * dev)), 3.0) * 6 + 1e-60)).alias("accel"))


def bca_of_mean(df: DataFrame, x: str, stats: DataFrame, probs: tuple[float, ...] = (0.025, 0.05, 0.10), by: list[str] = ("symbol",)) -> DataFrame:
    """``by, prob, low, high``: BCa bounds of the mean, whose leave-one-out values follow from the sum."""
    by = list(by)
    base = df.groupBy(*by).agg(F.avg(x).alias("theta"), F.count(x).alias("_n"), F.sum(x).alias("_sx"))
    left_out = df.join(base, by).select(*by, ((F.col("_sx") - F.col(x)) / (F.col("_n") - 1)).alias("_j"))
    held = stats.groupBy(*by).agg(F.array_sort(F.collect_list("stat")).alias("s")).join(base.select(*by, "theta"), by).join(acceleration(left_out, "_j", by), by)
    return bca(held.select("*", F.explode(F.array(*[F.lit(p) for p in probs])).alias("prob")), [*by, "prob"])


def permuted(df: DataFrame, reps: int, seed: int, first: int, x: str = "x", s: Series = MARKET, joint: bool = False, cuts: tuple[int, ...] = ()) -> DataFrame:
    """``by, rep, i, x``: replication 0 as it is, the others with their changes after bar ``first`` in random order.

    Order is a hash of replication and place: replications do not depend on each
    other. With ``joint`` all series of a replication share one order, so their
    correlations stay. Changes into the bars before, and from, each bar of ``cuts``
    stay on their side of it.
    """
    steps = df.withColumn("_step", F.col(x) - s.lag(x))
    reps_of = F.explode(F.sequence(F.lit(0), F.lit(reps - 1))).alias("rep")
    long = steps.select(*s.by, s.i, F.col(x).alias("_x"), "_step", reps_of)
    segment = sum(((F.col(s.i) >= c).cast("int") for c in cuts), F.lit(0))
    moved = long.where(F.col(s.i) > first).withColumn("_seg", segment)
    keys = [*s.by, "rep"]
    parts = ("rep", s.i) if joint else (*s.by, "rep", s.i)
    shuffled = F.when(F.col("rep") == 0, F.col(s.i).cast("long")).otherwise(rng.bits(seed, *parts))
    moved = moved.withColumn("_at", F.row_number().over(Window.partitionBy(*keys).orderBy("_seg", shuffled, s.i)) + first)
    upto = Window.partitionBy(*keys).orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    base = df.where(F.col(s.i) == first).select(*s.by, F.col(x).alias("_base"))
    rebuilt = moved.join(base, list(s.by)).select(*keys, F.col("_at").cast("int").alias(s.i), (F.col("_base") + F.sum("_step").over(upto)).alias(x))
    return long.where(F.col(s.i) <= first).select(*keys, s.i, F.col("_x").alias(x)).unionByName(rebuilt)


def permuted_bars(df: DataFrame, reps: int, seed: int, preserve_ends: bool = False, s: Series = MARKET) -> DataFrame:
    """``by, rep, i, lo, lh, ll, x``: overnight steps and days' shapes each in an order of their own.

    ``preserve_ends`` keeps the first overnight step and the last day's shape.
    """
    prev = s.lag("x")
    held = df.withColumn("_ro", F.col("lo") - prev).withColumn("_rh", F.col("lh") - F.col("lo")).withColumn("_rl", F.col("ll") - F.col("lo")).withColumn("_rc", F.col("x") - F.col("lo"))
    long = held.select("*", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))).alias("rep"))
    keys = [*s.by, "rep"]
    steps = long.where(F.col(s.i) >= 1)
    last = F.max(s.i).over(Window.partitionBy(*keys))
    fixed = F.lit(preserve_ends)
    over = F.when((F.col("rep") == 0) | (fixed & (F.col(s.i) == 1)), F.col(s.i).cast("long") - (1 << 53)).otherwise(rng.bits(seed, *keys, s.i))
    shape = F.when(F.col("rep") == 0, F.col(s.i).cast("long")).when(fixed & (F.col(s.i) == last), F.lit(1 << 53)).otherwise(rng.bits(seed + 1, *keys, s.i))
    steps = steps.withColumn("_over", over).withColumn("_shape", shape)
    nights = steps.select(*keys, F.row_number().over(Window.partitionBy(*keys).orderBy("_over", s.i)).alias(s.i), "_ro")
    days = steps.select(*keys, F.row_number().over(Window.partitionBy(*keys).orderBy("_shape", s.i)).alias(s.i), "_rh", "_rl", "_rc")
    start = df.where(F.col(s.i) == 0).select(*s.by, F.col("x").alias("_base"))
    both = nights.join(days, [*keys, s.i]).join(start, list(s.by))
    upto = Window.partitionBy(*keys).orderBy(s.i).rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("x", F.col("_base") + F.sum(F.col("_ro") + F.col("_rc")).over(upto)).withColumn("lo", F.col("x") - F.col("_rc"))
    both = both.select(*keys, F.col(s.i).cast("int").alias(s.i), "lo", (F.col("lo") + F.col("_rh")).alias("lh"), (F.col("lo") + F.col("_rl")).alias("ll"), "x")
    return long.where(F.col(s.i) == 0).select(*keys, s.i, "lo", "lh", "ll", "x").unionByName(both)


def mcpt_summary(found: DataFrame, by: list[str]) -> DataFrame:
    """p-value, training bias, skill and unbiased return from ``rep, value, trend`` rows; replication 0 is the data."""
    base = found.where("rep = 0").select(*[F.col(b).alias(f"_{b}") for b in by], F.col("value").alias("_v0"), F.col("trend").alias("_t0"))
    same = F.lit(True)
    for b in by:
        same = same & (F.col(b) == F.col(f"_{b}"))
    held = found.join(base, same).groupBy(*by).agg(
        F.avg((F.col("value") >= F.col("_v0")).cast("double")).alias("p_value"),
        F.max("_v0").alias("original"),
        F.max("_t0").alias("trend_component"),
        F.avg(F.when(F.col("rep") > 0, F.col("value") - F.col("trend"))).alias("training_bias"),
    )
    unbiased = F.col("original") - F.col("training_bias")
    return held.withColumn("unbiased", unbiased).withColumn("skill", unbiased - F.col("trend_component"))


def mcpt_trend(df: DataFrame, most: int, reps: int, seed: int, x: str = "x", s: Series = MARKET) -> DataFrame:
    """Is the best crossover better than on shuffled changes? One job for all replications; a row a replication is all that is shuffled."""
    top = replicate.best_crossovers(df, s.by, x, s.i, most, reps, seed)
    ends = df.groupBy(*s.by).agg(F.max_by(x, s.i).alias("_z"), F.max(F.when(F.col(s.i) == most - 1, F.col(x))).alias("_a"), F.count(F.lit(1)).alias("_n"))
    held = top.join(ends, list(s.by))
    trend = F.col("net") * (F.col("_z") - F.col("_a")) / (F.col("_n") - most)
    return mcpt_summary(held.select(*s.by, "rep", F.col("total").alias("value"), trend.alias("trend")), list(s.by))


def mcpt_bars(df: DataFrame, lookback: int, reps: int, seed: int, s: Series = MARKET) -> DataFrame:
    """The same question of the mean-reversion grid, with nights and days shuffled apart."""
    keyed = Series((*s.by, "rep"), s.i)
    shuffled = permuted_bars(df, reps, seed, s=s)
    grid = grids.reversal_grid(shuffled, lookback, s=keyed)
    top = grids.best(grid, "total", ["rise", "drop"], [*s.by, "rep"], ["rise", "drop", "total", "n_long"])
    ends = df.groupBy(*s.by).agg(F.max_by("lo", s.i).alias("_z"), F.max(F.when(F.col(s.i) == lookback + 1, F.col("lo"))).alias("_a"), F.count(F.lit(1)).alias("_n"))
    held = top.join(ends, list(s.by))
    trend = F.col("n_long") * (F.col("_z") - F.col("_a")) / (F.col("_n") - lookback - 2)
    return mcpt_summary(held.select(*s.by, "rep", F.col("total").alias("value"), trend.alias("trend")), list(s.by))


def block_of(place: Column, n: Column, blocks: int) -> Column:
    """The block of a place when n places are cut into nearly equal blocks, the longer ones last."""
    size = F.floor(n / blocks)
    short = (F.lit(blocks) - n % blocks) * size
    return F.when(place < short, F.floor(place / size)).otherwise(F.lit(blocks) - n % blocks + F.floor((place - short) / (size + 1))).cast("int")


def cscv(returns: DataFrame, blocks: int, first: int, by: str = "symbol", keys: tuple[str, ...] = ("long", "short")) -> DataFrame:
    """``by, n_splits, probability``: how often the best system of half the blocks is at or below the median of the rest.

    An even number of blocks is cut over all returns of each series, from bar
    ``first`` on. Sums by system and block are all that the splits need; the splits
    are the halves of a small number of blocks, a bounded relation.
    """
    blocks = blocks // 2 * 2
    sizes = returns.groupBy(by).agg((F.max("i") - first + 1).alias("_n"))
    placed = returns.join(sizes, by).withColumn("block", block_of(F.col("i") - first, F.col("_n"), blocks))
    sums = placed.groupBy(by, *keys, "block").agg(F.sum("ret").alias("s"), F.count(F.lit(1)).alias("c"))
    splits = [(k, b, b in inside) for k, inside in enumerate(combinations(range(blocks), blocks // 2)) for b in range(blocks)]
    halves = returns.sparkSession.createDataFrame(splits, "split int, block int, inside boolean")
    joined = sums.join(F.broadcast(halves), "block")
    mean = lambda side: F.sum(F.when(side, F.col("s"))) / F.sum(F.when(side, F.col("c")))
    scored = joined.groupBy(by, "split", *keys).agg(mean(F.col("inside")).alias("in_s"), mean(~F.col("inside")).alias("out_s"))
    top = grids.best(scored, "in_s", list(keys), [by, "split"], ["out_s", *keys]).select(by, "split", F.col("out_s").alias("_best"), *[F.col(k).alias(f"_{k}") for k in keys])
    mine = F.lit(True)
    for k in keys:
        mine = mine & (F.col(k) == F.col(f"_{k}"))
    ranked = scored.join(top, [by, "split"]).groupBy(by, "split").agg(
        F.sum((mine | (F.round("_best", 10) >= F.round("out_s", 10))).cast("int")).alias("rank"), F.count(F.lit(1)).alias("systems")
    )
    less = (F.col("rank") / (F.col("systems") + 1) <= 0.5).cast("double")
    return ranked.groupBy(by).agg(F.count(F.lit(1)).alias("n_splits"), F.avg(less).alias("probability"))


def stochastic_bias(returns: DataFrame, by: list[str], i: str = "i", keys: tuple[str, ...] = ("long", "short")) -> DataFrame:
    """``is_mean, oos_mean, bias``: for each bar the system that is best without it, and what that bar then pays."""
    totals = returns.groupBy(*by, *keys).agg(F.sum("ret").alias("_total"))
    held = returns.join(totals, [*by, *keys]).withColumn("_rest", F.col("_total") - F.col("ret"))
    order = F.struct("_rest", *[-F.col(k) for k in keys])
    bars = held.groupBy(*by, i).agg(F.max("_rest").alias("best"), F.max_by("ret", order).alias("paid"))
    n = F.count(F.lit(1))
    out = bars.groupBy(*by).agg((F.sum("best") / (n - 1)).alias("is_sum"), F.sum("paid").alias("oos_sum"))
    return out.withColumn("bias", F.col("is_sum") - F.col("oos_sum"))


def drawdown_quantiles(df: DataFrame, x: str, by: list[str], size: int, reps: int, seed: int, probs: tuple[float, ...] = (0.999, 0.99, 0.95, 0.90), i: str = "i") -> DataFrame:
    """``by, prob, drawdown``: quantiles of the worst drawdown of resampled paths of ``size`` returns of each series."""
    path = draws(df, by, reps, seed, size).join(df.select(*by, i, x), [*by, i])
    return quantile_rows(worst_drawdowns(path, x, [*by, "rep"]), by, probs)


def worst_drawdowns(path: DataFrame, x: str, keys: list[str], order: str = "j") -> DataFrame:
    """``keys, dd``: the worst fall from a peak, which starts at the first value, of each path of changes."""
    upto = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    held = path.withColumn("_c", F.sum(x).over(upto)).withColumn("_p", F.max("_c").over(upto))
    return held.groupBy(*keys).agg(F.max(F.col("_p") - F.col("_c")).alias("dd"))


def quantile_rows(worst: DataFrame, by: list[str], probs: tuple[float, ...]) -> DataFrame:
    held = worst.groupBy(*by).agg(*[order_quantile("dd", p).alias(f"q{k}") for k, p in enumerate(probs)])
    rows = F.explode(F.array(*[F.struct(F.lit(p).alias("prob"), F.col(f"q{k}").alias("drawdown")) for k, p in enumerate(probs)])).alias("_q")
    return held.select(*by, rows).select(*by, "_q.*")


#: Criteria by which a market is chosen, in the order in which the first of equals wins.
CHOICES = ("total", "sharpe", "profit_factor")


def criterion_picks(df: DataFrame, window: int, x: str = "x", by: str = "symbol", i: str = "i", keys: tuple[str, ...] = ()) -> DataFrame:
    """``keys, i, criterion, market, ret``: the best market by each criterion of its last ``window`` prices, and its next return.

    The series must share their time axis ``i``. Of equal markets the first by name wins.
    """
    order = Window.partitionBy(*keys, by).orderBy(i)
    n = window - 1
    last = order.rowsBetween(1 - n, 0)
    held = df.withColumn("_r", F.col(x) - F.lag(x).over(order)).withColumn("_next", F.lead(x).over(order) - F.col(x))
    total, sq = F.sum("_r").over(last), F.sum(F.col("_r") * F.col("_r")).over(last)
    wins, losses = F.sum(F.greatest("_r", F.lit(0.0))).over(last), F.sum(F.greatest(-F.col("_r"), F.lit(0.0))).over(last)
    mean = total / n
    sharpe = mean / F.sqrt(F.greatest(sq / n - mean * mean, F.lit(0.0)) + 1e-60)
    scores = F.array(F.round(total, 10), F.round(sharpe, 10), F.round((wins + 1e-60) / (losses + 1e-60), 10))
    scored = held.select(*keys, by, i, "_next", scores.alias("_c")).where((F.col(i) >= n) & F.col("_next").isNotNull())
    rows = scored.select(*keys, by, i, "_next", F.posexplode("_c").alias("criterion", "_v"))
    best = F.min_by(F.struct(F.col("_next").alias("ret"), F.col(by).alias("market")), F.struct(-F.col("_v"), F.col(by)))
    return rows.groupBy(*keys, i, "criterion").agg(best.alias("_b")).select(*keys, i, "criterion", "_b.*")


def final_picks(picks: DataFrame, out_window: int, i: str = "i", keys: tuple[str, ...] = ()) -> DataFrame:
    """``keys, i, criterion, market, ret``: of ``criterion_picks`` those of the criterion that earned most over the last ``out_window`` bars."""
    past = Window.partitionBy(*keys, "criterion").orderBy(i).rowsBetween(-out_window, -1)
    ranked = picks.withColumn("_sum", F.round(F.sum("ret").over(past), 10)).withColumn("_n", F.count("ret").over(past)).where(F.col("_n") == out_window)
    chosen = ranked.groupBy(*keys, i).agg(F.max_by(F.struct("criterion", "market", "ret"), F.struct("_sum", -F.col("criterion"))).alias("_b"))
    return chosen.select(*keys, i, "_b.*")


def chooser(df: DataFrame, window: int, out_window: int, x: str = "x", by: str = "symbol", i: str = "i", keys: tuple[str, ...] = ()) -> DataFrame:
    """Nested walk-forward choice of a market: at each bar the criterion that lately chose best chooses the next bar's market."""
    return final_picks(criterion_picks(df, window, x, by, i, keys), out_window, i, keys)
