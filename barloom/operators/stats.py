"""Tests, contingency, entropy, quantiles, moments and criteria, as grouped aggregates.

Every function takes the columns to group by; totals are folded per task before
they are shuffled. Ranks are numbered within a group only where the statistic
needs them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import dist
from . import ordered

TINY = 1e-60


def _keys(by: Sequence[str]) -> list[str]:
    return list(by)


def t_one(df: DataFrame, x: str, by: Sequence[str] = ()) -> DataFrame:
    """``n, mean, t``: mean over its standard error."""
    n, mean = F.count(x), F.avg(x)
    se = F.sqrt(F.var_samp(x) / n) + F.lit(TINY)
    return df.groupBy(*_keys(by)).agg(n.alias("n"), mean.alias("mean"), (mean / se).alias("t"))


def t_two(df: DataFrame, x: str, first: Column, by: Sequence[str] = ()) -> DataFrame:
    """Pooled two-sample t of ``x`` where ``first`` holds against the rest; 0 where the error vanishes."""
    a, b = F.when(first, F.col(x)), F.when(~first, F.col(x))
    held = df.groupBy(*_keys(by)).agg(
        F.count(a).alias("n1"), F.count(b).alias("n2"), F.avg(a).alias("m1"), F.avg(b).alias("m2"), F.var_pop(a).alias("v1"), F.var_pop(b).alias("v2")
    )
    pooled = (F.col("v1") * F.col("n1") + F.col("v2") * F.col("n2")) / (F.col("n1") + F.col("n2") - 2)
    se = F.sqrt(pooled * (F.lit(1.0) / F.col("n1") + F.lit(1.0) / F.col("n2")))
    return held.withColumn("t", F.when(se < 1e-10, F.lit(0.0)).otherwise(F.try_divide(F.col("m1") - F.col("m2"), se)))


def mid_ranks(df: DataFrame, x: str, by: Sequence[str] = ()) -> DataFrame:
    """``df`` with ``rank`` (the mean of tied places) and ``tied`` (how many share the value)."""
    keys = _keys(by)
    counts = df.groupBy(*keys, x).agg(F.count(F.lit(1)).alias("tied"))  # one row a value
    ranks = ordered.counts_before(counts, x, "tied", keys).withColumn("rank", F.col("before") + (F.col("tied") + 1) / 2)
    return df.join(ranks.drop("before"), [*keys, x])


def mann_whitney(df: DataFrame, x: str, first: Column, by: Sequence[str] = ()) -> DataFrame:
    """``u, z`` with mid-ranks and the tie correction; rows are folded to values before any order is made."""
    keys = _keys(by)
    counts = df.groupBy(*keys, x).agg(F.count(F.lit(1)).alias("tied"), F.count_if(first).alias("_first"), F.count_if(~first).alias("_rest"))
    rank = F.col("before") + (F.col("tied") + 1) / 2
    tied = F.col("tied").cast("double")
    sums = ordered.counts_before(counts, x, "tied", keys).groupBy(*keys).agg(
        F.sum("_first").alias("n1"), F.sum("_rest").alias("n2"), F.sum(F.col("_first") * rank).alias("r1"), F.sum(tied * (tied * tied - 1)).alias("ties"),
    )
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    n = n1 + n2
    u = n1 * n2 + n1 * (n1 + 1) / 2 - F.col("r1")
    var = n1 * n2 / (n * (n - 1)) * ((n * n * n - n) / 12 - F.col("ties") / 12)
    return sums.select(*keys, u.alias("u"), F.try_divide(u - n1 * n2 / 2, F.sqrt(var)).alias("z"))


def _placed_values(df: DataFrame, x: str, keys: list[str]) -> DataFrame:
    """A row a value: ``tied`` that have it, ``before`` that are less, and ``_n`` of its key."""
    counts = df.groupBy(*keys, x).agg(F.count(F.lit(1)).alias("tied"))
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return ordered.same(keys, ordered.counts_before(counts, x, "tied", keys), sizes)


def ks_uniform(df: DataFrame, x: str, by: Sequence[str] = ()) -> DataFrame:
    """``d_plus, d_minus`` against the uniform on (0, 1)."""
    keys = _keys(by)
    held = _placed_values(df, x, keys)
    above = F.max((F.col("before") + F.col("tied")) / F.col("_n") - F.col(x))
    return held.groupBy(*keys).agg(above.alias("d_plus"), F.max(F.col(x) - F.col("before") / F.col("_n")).alias("d_minus"))


def anderson_darling(df: DataFrame, x: str, by: Sequence[str] = ()) -> DataFrame:
    """``a2, p`` against the uniform on (0, 1); terms are floored at 1e-30.

    The odd numbers 2 r - 1 of the places of a value add up to a difference of squares.
    """
    keys = _keys(by)
    held = _placed_values(df, x, keys)
    square = lambda c: c.cast("double") * c.cast("double")
    b, after = F.col("before"), F.col("_n") - F.col("before")
    up = (square(b + F.col("tied")) - square(b)) * F.log(F.greatest(F.col(x), F.lit(1e-30)))
    down = (square(after) - square(after - F.col("tied"))) * F.log(F.greatest(1 - F.col(x), F.lit(1e-30)))
    sums = held.groupBy(*keys).agg(F.max("_n").alias("n"), F.sum(up + down).alias("s"))
    a2 = -F.col("n") - F.col("s") / F.col("n")
    return sums.withColumn("a2", a2).select(*keys, "a2", F.expr(dist.anderson_darling_sql("a2")).alias("p"))


def anova(df: DataFrame, x: str, group: str, by: Sequence[str] = ()) -> DataFrame:
    """``f, account, p``: one-way analysis; ``account`` is the share of mean squares between groups."""
    keys = _keys(by)
    cells = df.groupBy(*keys, group).agg(F.count(x).alias("n"), F.sum(x).alias("s"), F.avg(x).alias("m"), F.var_pop(x).alias("v"))
    total = cells.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("k"),
        F.sum("n").alias("n"),
        F.sum(F.col("s") * F.col("m")).alias("sm"),
        F.sum("s").alias("s"),
        F.sum(F.col("v") * F.col("n")).alias("within"),
    )
    between = (F.col("sm") - F.col("s") * F.col("s") / F.col("n")) / (F.col("k") - 1)
    inside = F.col("within") / (F.col("n") - F.col("k"))
    held = total.withColumn("b", between).withColumn("w", inside)
    held = held.withColumn("f", F.col("b") / (F.col("w") + F.lit(TINY))).withColumn("account", F.col("b") / (F.col("b") + F.col("w") + F.lit(TINY)))
    p = F.lit(1.0) - dist.f_cdf((F.col("k") - 1).cast("double"), (F.col("n") - F.col("k")).cast("double"), F.col("f"))
    return held.withColumn("p", p).select(*keys, "k", "n", "f", "account", "p")


def kruskal_wallis(df: DataFrame, x: str, group: str, by: Sequence[str] = ()) -> DataFrame:
    """``h, p`` with mid-ranks and the tie correction."""
    keys = _keys(by)
    ranked = mid_ranks(df, x, by)
    ties = ranked.groupBy(*keys).agg(F.sum(F.col("tied").cast("double") * F.col("tied") - 1).alias("ties"), F.count(F.lit(1)).alias("n"))
    cells = ranked.groupBy(*keys, group).agg(F.sum("rank").alias("r"), F.count(F.lit(1)).alias("c"))
    sums = cells.groupBy(*keys).agg(F.sum(F.col("r") * F.col("r") / F.col("c")).alias("rr"), F.count(F.lit(1)).alias("k"))
    held = sums.join(ties, keys) if keys else sums.join(ties, F.lit(True))
    n = F.col("n").cast("double")
    h = (F.col("rr") * 12 / (n * (n + 1)) - 3 * (n + 1)) / (1 - F.col("ties") / (n * n * n - n))
    return held.withColumn("h", h).select(*keys, "k", "n", "h", dist.chi2_tail((F.col("k") - 1).cast("double"), F.col("h")).alias("p"))


def _table(df: DataFrame, row: str, col: str) -> DataFrame:
    """Cells with both margins and the total; a table has as many rows as categories."""
    cells = df.groupBy(F.col(row).alias("r"), F.col(col).alias("c")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    rows = cells.groupBy("r").agg(F.sum("n").alias("nr"))
    cols = cells.groupBy("c").agg(F.sum("n").alias("nc"))
    return cells.join(rows, "r").join(cols, "c").join(cells.agg(F.sum("n").alias("t")), F.lit(True))


def chi_square(df: DataFrame, row: str, col: str) -> DataFrame:
    """``chi2, df, contingency, cramer_v, p`` of a two-way table; cells that are empty count by their expectation."""
    held = _table(df, row, col)
    expected = F.col("nr") * F.col("nc") / F.col("t")
    sums = held.agg(
        F.sum(F.pow(F.col("n") - expected, 2) / expected).alias("a"), F.sum(expected).alias("seen"), F.max("t").alias("t"),
        F.count_distinct("r").alias("rows"), F.count_distinct("c").alias("cols"),
    )
    chi = F.col("a") + F.col("t") - F.col("seen")
    out = sums.withColumn("chi2", chi).withColumn("df", ((F.col("rows") - 1) * (F.col("cols") - 1)).cast("double"))
    cont = F.sqrt(F.col("chi2") / (F.col("chi2") + F.col("t")))
    v = F.sqrt(F.try_divide(F.col("chi2"), F.col("t") * (F.least("rows", "cols") - 1)))
    return out.select("chi2", "df", cont.alias("contingency"), v.alias("cramer_v"), dist.chi2_tail(F.col("df"), F.col("chi2")).alias("p"))


def nominal_lambda(df: DataFrame, row: str, col: str) -> DataFrame:
    """``row_dep, col_dep, symmetric``: proportional reduction of prediction error."""
    held = _table(df, row, col)
    in_col = held.groupBy("c").agg(F.max("n").alias("m"), F.max("nc").alias("nc"), F.max("t").alias("t"))
    in_row = held.groupBy("r").agg(F.max("n").alias("m"), F.max("nr").alias("nr"))
    a = in_col.agg(F.sum("m").alias("by_col"), F.max("nc").alias("top_col"), F.max("t").alias("t"))
    b = in_row.agg(F.sum("m").alias("by_row"), F.max("nr").alias("top_row"))
    both = a.join(b, F.lit(True))
    t, rows, cols = F.col("t"), F.col("by_col") - F.col("top_row"), F.col("by_row") - F.col("top_col")
    return both.select(
        F.coalesce(F.try_divide(rows, t - F.col("top_row")), F.lit(1.0)).alias("row_dep"),
        F.coalesce(F.try_divide(cols, t - F.col("top_col")), F.lit(1.0)).alias("col_dep"),
        F.coalesce(F.try_divide(rows + cols, t * 2 - F.col("top_row") - F.col("top_col")), F.lit(1.0)).alias("symmetric"),
    )


def uncertainty(df: DataFrame, row: str, col: str) -> DataFrame:
    """``row_dep, col_dep, symmetric``: shares of entropy that the other variable explains."""
    held = _table(df, row, col)
    ent = lambda p: -F.sum(p * F.log(p))
    joint = held.agg(ent(F.col("n") / F.col("t")).alias("hj"))
    hr = held.select("r", "nr", "t").distinct().agg(ent(F.col("nr") / F.col("t")).alias("hr"))
    hc = held.select("c", "nc", "t").distinct().agg(ent(F.col("nc") / F.col("t")).alias("hc"))
    both = joint.join(hr, F.lit(True)).join(hc, F.lit(True))
    shared = F.col("hr") + F.col("hc") - F.col("hj")
    return both.select(
        F.try_divide(shared, F.col("hr")).alias("row_dep"), F.try_divide(shared, F.col("hc")).alias("col_dep"), F.try_divide(shared * 2, F.col("hr") + F.col("hc")).alias("symmetric")
    )


def order_quantile(x: Column | str, q: float | Column) -> Column:
    """The order statistic floor(q (n + 1)), clamped: an aggregate over a group of bounded size (``ordered.quantiles`` takes any)."""
    held = F.array_sort(F.collect_list(x))
    k = F.floor((q if isinstance(q, Column) else F.lit(q)) * (F.size(held) + 1)) - 1
    at = F.least(F.greatest(k.cast("int"), F.lit(0)), F.size(held) - 1) + 1
    return F.when(F.size(held) > 0, F.element_at(held, at))


def moments(x: str) -> list[Column]:
    """Count, mean, population variance, skewness and kurtosis (3 for the normal), all from mergeable sums."""
    return [F.count(x).alias("n"), F.avg(x).alias("mean"), F.var_pop(x).alias("variance"), F.skewness(x).alias("skewness"), (F.kurtosis(x) + 3).alias("kurtosis")]


def roc_area(df: DataFrame, pred: str, gain: str, tie: str, center: bool = False, by: Sequence[str] = ()) -> DataFrame:
    """Area under the gain-weighted curve: wins ahead of losses in falling order of ``pred``; 0.5 if one side is missing."""
    keys = _keys(by)
    held = df.withColumn("_g", F.col(gain))
    if center:
        held = ordered.same(keys, df, df.groupBy(*keys).agg(F.avg(gain).alias("_mean"))).withColumn("_g", F.col(gain) - F.col("_mean"))
    held = held.withColumn("_win", F.greatest("_g", F.lit(0.0))).withColumn("_loss", F.greatest(-F.col("_g"), F.lit(0.0)))
    if keys:
        order = Window.partitionBy(*keys).orderBy(F.col(pred).desc(), F.col(tie)).rowsBetween(Window.unboundedPreceding, 0)
        held = held.withColumn("_won", F.sum("_win").over(order))
    else:  # one order of all rows, made in blocks
        narrow = held.select(F.col(pred).alias("_pred"), F.col(tie).alias("_tie"), "_win", "_loss")
        held = ordered.running(ordered.placed(narrow, [F.col("_pred").desc(), F.col("_tie")]), {"_before": "_win"}).withColumn("_won", F.col("_before") + F.col("_win"))
    sums = held.groupBy(*keys).agg(F.sum(F.col("_won") * F.col("_loss")).alias("a"), F.sum("_win").alias("w"), F.sum("_loss").alias("l"))
    area = F.when((F.col("w") <= 0) | (F.col("l") <= 0), F.lit(0.5)).otherwise(F.try_divide(F.col("a"), F.col("w") * F.col("l")))
    return sums.select(*keys, area.alias("roc_area"))


def relative_entropy(df: DataFrame, x: str, bins: int, by: Sequence[str] = ()) -> DataFrame:
    """Entropy over equal-width bins, relative to that of the uniform."""
    keys = _keys(by)
    ends = df.groupBy(*keys).agg(F.min(x).alias("_lo"), F.max(x).alias("_hi"), F.count(x).alias("_n"))
    held = df.where(F.col(x).isNotNull()).join(F.broadcast(ends) if not keys else ends, keys if keys else F.lit(True))
    factor = F.lit(bins - 1e-10) / (F.col("_hi") - F.col("_lo") + F.lit(TINY))
    cells = held.groupBy(*keys, F.floor(factor * (F.col(x) - F.col("_lo"))).alias("_b")).agg(F.count(F.lit(1)).alias("_c"), F.max("_n").alias("_n"))
    p = F.col("_c") / F.col("_n")
    return cells.groupBy(*keys).agg((-F.sum(p * F.log(p)) / F.log(F.lit(float(bins)))).alias("entropy"))


def regression(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """``beta, constant`` of y on x."""
    beta = F.covar_pop(x, y) * F.count(y) / (F.var_pop(x) * F.count(y) + F.lit(TINY))
    return df.groupBy(*_keys(by)).agg(beta.alias("beta"), (F.avg(y) - beta * F.avg(x)).alias("constant"))


def criteria(ret: str) -> list[Column]:
    """Total, mean, profit factor, Sharpe and win/loss ratio of returns, with their guards."""
    r = F.col(ret)
    wins, losses = F.sum(F.greatest(r, F.lit(0.0))), F.sum(F.greatest(-r, F.lit(0.0)))
    return [
        F.sum(r).alias("total"),
        F.avg(r).alias("mean"),
        ((wins + F.lit(TINY)) / (losses + F.lit(TINY))).alias("profit_factor"),
        (F.avg(r) / (F.stddev_pop(r) + F.lit(TINY))).alias("sharpe"),
        ((wins + F.lit(1e-10)) / (losses + F.lit(1e-10))).alias("win_loss"),
        F.log((wins + F.lit(1e-10)) / (losses + F.lit(1e-10))).alias("log_pf"),
    ]


def drawdown(df: DataFrame, ret: str, order: str, by: Sequence[str] = ()) -> DataFrame:
    """``max_drawdown`` of a path of returns, whose peak starts at the first, and as a percentage of equity."""
    part = Window.partitionBy(*_keys(by)).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    held = df.withColumn("_cum", F.sum(ret).over(part)).withColumn("_peak", F.max("_cum").over(part))
    worst = F.max(F.col("_peak") - F.col("_cum"))
    return held.groupBy(*_keys(by)).agg(worst.alias("max_drawdown"), ((F.lit(1.0) - F.exp(-worst)) * 100).alias("drawdown_pct"))


def performance(df: DataFrame, ret: str, order: str, by: Sequence[str] = (), risk_free: float = 0.0, periods: float = 252.0) -> DataFrame:
    """Total return, annual volatility, Sharpe ratio and worst drawdown of simple returns."""
    keys = _keys(by)
    part = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    held = df.withColumn("_eq", F.exp(F.sum(F.log(1 + F.col(ret))).over(part)))
    held = held.withColumn("_peak", F.greatest(F.max("_eq").over(part), F.lit(1.0)))
    vol = F.stddev_samp(ret) * F.sqrt(F.lit(periods))
    return held.groupBy(*keys).agg(
        (F.exp(F.sum(F.log(1 + F.col(ret)))) - 1).alias("total_return"),
        vol.alias("volatility"),
        F.try_divide(F.avg(ret) * periods - risk_free, vol).alias("sharpe"),
        F.max(1 - F.col("_eq") / F.col("_peak")).alias("max_drawdown"),
    )


def t_summary(df: DataFrame, x: str, by: Sequence[str] = ()) -> DataFrame:
    """``n, mean, sd, t, p, lower``: t of the mean, its upper-tail chance, and the 90 % lower bound."""
    held = df.groupBy(*_keys(by)).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd"))
    se = F.col("sd") / F.sqrt(F.col("n"))
    df_ = (F.col("n") - 1).cast("double")
    held = held.withColumn("t", F.col("mean") / (se + F.lit(TINY)))
    return held.withColumn("p", 1 - dist.t_cdf(df_, F.col("t"))).withColumn("lower", F.col("mean") - se * dist.inverse_t(df_, F.lit(0.9)))
