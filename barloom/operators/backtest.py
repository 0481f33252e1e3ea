"""Backtest of a signal column as windows and one aggregate: no loop over bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def legs(df: DataFrame, cost_pct: float, by: str = "symbol", i: str = "i", x: str = "x", signal: str = "signal") -> tuple[DataFrame, DataFrame]:
    """(bars with ``leg`` and ``pos``, one row a leg).

    A leg begins where a non-zero signal differs from the one before it, and
    ends at the next leg's first bar or at the last bar. Opening costs a factor
    1 - c, closing 1 + r - c, with c the cost of a side.
    """
    order = Window.partitionBy(by).orderBy(i)
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    held = df.withColumn("_nz", F.nullif(F.col(signal), F.lit(0))).withColumn("_p", F.exp(x))
    held = held.withColumn("pos", F.coalesce(F.last("_nz", ignorenulls=True).over(upto), F.lit(0)))
    held = held.withColumn("_open", ((F.col("pos") != F.coalesce(F.lag("pos").over(order), F.lit(0))) & (F.col("pos") != 0)).cast("int"))
    held = held.withColumn("leg", F.sum("_open").over(upto)).withColumn("_end", F.max(i).over(Window.partitionBy(by)))
    held = held.withColumn("_last", F.last("_p").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    starts = held.where("_open = 1").select(by, "leg", F.col(i).alias("entry_index"), F.col("_p").alias("entry_price"), F.col("pos").alias("side"), "_end", "_last")
    nxt = Window.partitionBy(by).orderBy("leg")
    out = starts.withColumn("forced", F.lead("leg").over(nxt).isNull())
    out = out.withColumn("exit_index", F.coalesce(F.lead("entry_index").over(nxt), F.col("_end")))
    out = out.withColumn("exit_price", F.coalesce(F.lead("entry_price").over(nxt), F.col("_last")))
    r = F.when(F.col("side") == 1, F.col("exit_price") / F.col("entry_price")).otherwise(F.col("entry_price") / F.col("exit_price")) - 1
    c = cost_pct / 100.0
    out = out.withColumn("r", r).withColumn("_grow", F.log(F.lit(1.0 - c)) + F.log(1 + F.col("r") - c))
    before = F.coalesce(F.sum("_grow").over(nxt.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return held, out.withColumn("_before", before).drop("_end", "_last")


def trades(df: DataFrame, initial: float, cost_pct: float, **kw) -> DataFrame:
    """One row a trade: places, prices, side, profit, return, costs."""
    _, out = legs(df, cost_pct, **kw)
    c = cost_pct / 100.0
    cash = F.exp(F.col("_before")) * initial
    opened = cash * (1 - c)
    by = kw.get("by", "symbol")
    return out.select(
        by, "leg", "entry_index", "entry_price", "exit_index", "exit_price",
        F.when(F.col("side") == 1, F.lit("LONG")).otherwise(F.lit("SHORT")).alias("trade_type"),
        (opened * F.col("r")).alias("pnl"),
        (F.col("r") * 100).alias("return_pct"),
        (cash * c + opened * c).alias("costs"),
        F.try_divide(F.col("r"), 1 + F.col("r") - c).alias("booked_return"),
        (opened * (1 + F.col("r") - c)).alias("budget"),
        "forced",
    )


def equity(df: DataFrame, initial: float, cost_pct: float, mark_always: bool = False, **kw) -> DataFrame:
    """Each bar's budget before its own action; marked to market where the signal holds.

    A repeated signal in the direction held leaves the bar unmarked;
    ``mark_always`` marks those too.
    """
    by, i, signal = kw.get("by", "symbol"), kw.get("i", "i"), kw.get("signal", "signal")
    bars, out = legs(df, cost_pct, **kw)
    c = cost_pct / 100.0
    cash = out.select(F.col(by).alias("_by"), F.col("leg").alias("_leg"), "side", "entry_price", (F.exp(F.col("_before")) * initial).alias("_cash"), ((F.exp(F.col("_before")) * initial) * (1 - c)).alias("_in"))
    held = bars.join(cash, (F.col(by) == F.col("_by")) & (F.col("leg") == F.col("_leg")), "left")
    gain = F.when(F.col("side") == 1, F.col("_p") / F.col("entry_price")).otherwise(F.col("entry_price") / F.col("_p"))
    order = Window.partitionBy(by).orderBy(i)
    before_open = F.lag("_in").over(order)
    at_switch = F.col("_open") == 1
    marked = F.col(signal) == 0 if not mark_always else ~at_switch
    # at a leg's first bar the budget is still that of the leg before, at cost
    value = F.when(F.col("pos") == 0, F.lit(float(initial))).when(at_switch, F.coalesce(before_open, F.lit(float(initial)))).when(marked, F.col("_in") * gain).otherwise(F.col("_in"))
    return held.select(by, i, F.when(at_switch, F.coalesce(F.lag("pos").over(order), F.lit(0))).otherwise(F.col("pos")).alias("position"), value.alias("equity"))


def summary(df: DataFrame, initial: float, cost_pct: float, **kw) -> DataFrame:
    """Final budget, trades, wins, costs, worst drawdown and annual Sharpe ratio of each series."""
    by, i = kw.get("by", "symbol"), kw.get("i", "i")
    done = trades(df, initial, cost_pct, **kw)
    order = Window.partitionBy(by).orderBy(i).rowsBetween(Window.unboundedPreceding, 0)
    path = equity(df, initial, cost_pct, **kw)
    path = path.withColumn("_peak", F.greatest(F.max("equity").over(order), F.lit(float(initial))))
    path = path.withColumn("_dd", (F.col("_peak") - F.col("equity")) / F.col("_peak"))
    dd = path.groupBy(by).agg((F.max("_dd") * 100).alias("max_drawdown"))
    win = (F.col("pnl") > 0).cast("long")
    deviation = F.stddev_pop("booked_return")
    totals = done.groupBy(by).agg(
        F.max_by("budget", "leg").alias("final_budget"),
        (F.count(F.lit(1)) * 2).alias("num_trades"),
        F.sum(win).alias("num_wins"),
        F.sum(1 - win).alias("num_losses"),
        F.sum("costs").alias("total_costs"),
        F.when(deviation > 0, F.avg("booked_return") / deviation * F.sqrt(F.lit(252.0))).otherwise(F.lit(0.0)).alias("sharpe_ratio"),
    )
    held = dd.join(totals, by, "left")
    final = F.coalesce("final_budget", F.lit(float(initial)))
    return held.select(
        by,
        final.alias("final_budget"),
        (final - initial).alias("total_pnl"),
        ((final - initial) / initial * 100).alias("roi_percent"),
        F.coalesce("num_trades", F.lit(0)).cast("long").alias("num_trades"),
        F.coalesce("num_wins", F.lit(0)).cast("long").alias("num_wins"),
        F.coalesce("num_losses", F.lit(0)).cast("long").alias("num_losses"),
        F.coalesce(F.try_divide(F.col("num_wins") * 100.0, F.col("num_wins") + F.col("num_losses")), F.lit(0.0)).alias("win_rate"),
        F.coalesce("total_costs", F.lit(0.0)).alias("total_costs"),
        "max_drawdown",
        F.coalesce("sharpe_ratio", F.lit(0.0)).alias("sharpe_ratio"),
    )


def predicted(features: Column, model: dict) -> Column:
    """The linear model's value of an array of features: one fold in the projection."""
    betas, means, scales = (F.array(*[F.lit(float(v)) for v in model[k]]) for k in ("beta", "xmeans", "xscales"))
    terms = F.zip_with(F.arrays_zip(features.alias("f"), means.alias("m"), scales.alias("s")), betas, lambda z, b: (z["f"] - z["m"]) / z["s"] * b)
    return F.aggregate(terms, F.lit(0.0), lambda a, v: a + v) * float(model["yscale"]) + float(model["ymean"])


def out_of_sample(df: DataFrame, pred: str, target: str, by: str = "symbol") -> DataFrame:
    """Sum of targets by the prediction's sign, and as a percentage."""
    total = F.sum(F.signum(pred) * F.col(target))
    return df.groupBy(by).agg(total.alias("total"), ((F.exp(total) - 1) * 100).alias("pct"))
