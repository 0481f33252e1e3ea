"""Order over a cluster: exact quantiles, ranks, running sums and linear recurrences of series of any length.

A window over an unkeyed table, or over one busy symbol, is one task. Here rows are
sorted by range and cut into blocks; blocks are worked on apart, their totals are
composed in order, and each block gets what stands before it. A block is a bounded
number of rows, the totals are one row a block.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.scratch import kept

#: Rows of a block.
ROWS = 1 << 16


def same(by: Sequence[str], a: DataFrame, b: DataFrame, how: str = "inner") -> DataFrame:
    """``a`` joined to ``b`` by equal keys, nulls too; without keys ``b`` has a few rows, which all of ``a`` meets."""
    if not by:
        return a.join(F.broadcast(b), F.lit(True), how)
    other = {c: f"_key_{c}" for c in by}
    met = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(o)) for c, o in other.items()])
    return a.join(b.withColumnsRenamed(other), met, how).drop(*other.values())


def placed(df: DataFrame, order: Sequence[str | Column], rows: int = ROWS) -> DataFrame:
    """``df`` sorted over the cluster, as a table with ``_at``, which rises in that order, and ``_block``, of at most ``rows`` rows that follow each other.

    Ranges are sampled over all of ``order``, so a key that holds most rows is cut too.
    """
    spread = df.repartitionByRange(*order).sortWithinPartitions(*order)
    return kept(spread.withColumn("_at", F.monotonically_increasing_id()).withColumn("_block", F.floor(F.col("_at") / rows).cast("long")), "placed")


def running(held: DataFrame, sums: dict[str, Column | str], by: Sequence[str] = (), last: dict[str, str] | None = None) -> DataFrame:
    """``held`` (as ``placed`` gives it) with, for each name of ``sums``, the sum over the rows before in its key, 0 at first.

    ``last``: names of columns to be made of other columns' values in the row before
    (null at first). Sums of whole numbers are exact.
    """
    last = last or {}
    by = list(by)
    place = Window.partitionBy(*by, "_block").orderBy("_at")
    before = place.rowsBetween(Window.unboundedPreceding, -1)
    value = {n: F.expr(c) if isinstance(c, str) else c for n, c in sums.items()}
    local = held.select("*", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_l_{n}") for n, c in value.items()], *[F.lag(c).over(place).alias(f"_p_{n}") for n, c in last.items()], F.row_number().over(place).alias("_row"))
    totals = held.groupBy(*by, "_block").agg(F.count(F.lit(1)).alias("_n"), *[F.sum(c).alias(f"_t_{n}") for n, c in value.items()], *[F.max_by(c, "_at").alias(f"_e_{n}") for n, c in last.items()])
    turn = Window.partitionBy(*by).orderBy("_block")
    earlier = turn.rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*by, "_block", *[F.coalesce(F.sum(f"_t_{n}").over(earlier), F.lit(0)).alias(f"_s_{n}") for n in value], *[F.lag(f"_e_{n}").over(turn).alias(f"_b_{n}") for n in last])
    met = same([*by, "_block"], local, starts)
    made = [(F.col(f"_l_{n}") + F.col(f"_s_{n}")).alias(n) for n in value]
    made += [F.when(F.col("_row") == 1, F.col(f"_b_{n}")).otherwise(F.col(f"_p_{n}")).alias(n) for n in last]
    return met.select(*held.columns, *made)


def counts_before(counts: DataFrame, x: str, n: str, by: Sequence[str] = (), rows: int = ROWS) -> DataFrame:
    """``counts`` (a row a value ``x``, and key, with ``n`` of them) with ``before``, how many are less."""
    if by:
        less = Window.partitionBy(*by).orderBy(x).rowsBetween(Window.unboundedPreceding, -1)
        return counts.withColumn("before", F.coalesce(F.sum(n).over(less), F.lit(0)))
    return running(placed(counts, [x], rows), {"before": n}).drop("_at", "_block")


def quantiles(df: DataFrame, x: str, probs: Sequence[float], by: Sequence[str] = (), most: int = 10_000, splitters: int = 128) -> DataFrame:
    """``by, prob, n, quantile``: the order statistics floor(prob (n + 1)), clamped to what is there, exact and over groups of any size.

    A round takes approximate splitters of what a place's bracket holds, counts what
    is less than, equal to and above three of them, and goes on in the part that
    holds the place; a bracket of at most ``most`` rows is sorted. Rounds are
    logarithmic in the group's size, a round reads the column twice, and what is
    shuffled are sketches and counts. Null values do not count; a group without
    any has no row.
    """
    by = list(by)
    rows = df.select(*by, F.col(x).alias("_x")).where("_x IS NOT NULL")
    grid = [k / splitters for k in range(splitters + 1)]
    wanted = F.explode(F.array(*[F.lit(float(p)) for p in probs])).alias("prob")
    sizes = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
    targets = sizes.where("n > 0").select(*by, "n", "_lo", "_hi", wanted)
    k = F.least(F.greatest(F.floor(F.col("prob") * (F.col("n") + 1)) - 1, F.lit(0)), F.col("n") - 1).cast("long")
    # _k: the place within the bracket [_lo, _hi], from 0; _m: how many the bracket holds
    targets = kept(targets.withColumn("_k", k).withColumn("_m", F.col("n")), "targets")
    done = []
    keys = [*by, "prob"]
    while True:
        found = targets.where("_lo = _hi").select(*keys, "n", F.col("_lo").alias("quantile"))
        small = targets.where((F.col("_lo") < F.col("_hi")) & (F.col("_m") <= most))
        done.append(found)
        if not small.isEmpty():
            held = same(by, rows, small).where(F.col("_x").between(F.col("_lo"), F.col("_hi")))
            sorted_ = held.groupBy(*keys).agg(F.array_sort(F.collect_list("_x")).alias("_v"), F.first("n").alias("n"), F.first("_k").alias("_k"))
            done.append(kept(sorted_.select(*keys, "n", F.get("_v", F.col("_k").cast("int")).alias("quantile")), "quantiles"))
        targets = targets.where((F.col("_lo") < F.col("_hi")) & (F.col("_m") > most))
        if targets.isEmpty():
            return reduce(DataFrame.unionByName, done)
        inside = same(by, rows, targets).where(F.col("_x").between(F.col("_lo"), F.col("_hi")))
        sketch = inside.groupBy(*keys).agg(F.percentile_approx("_x", grid, 20 * splitters).alias("_s"))
        at = F.floor(F.col("_k") / F.col("_m") * splitters).cast("int")
        split = same(keys, targets, sketch).select(*targets.columns, F.get("_s", F.greatest(at - 1, F.lit(0))).alias("_a"), F.get("_s", at).alias("_b"), F.get("_s", F.least(at + 2, F.lit(splitters))).alias("_c"))
        split = kept(split, "split")
        held = same(by, rows, split).where(F.col("_x").between(F.col("_lo"), F.col("_hi")))
        at = F.col("_x")
        counted = held.groupBy(*keys).agg(
            F.count_if(at < F.col("_a")).alias("_n0"), F.count_if((at >= F.col("_a")) & (at < F.col("_b"))).alias("_n1"), F.count_if(at == F.col("_b")).alias("_n2"), F.count_if((at > F.col("_b")) & (at <= F.col("_c"))).alias("_n3"),
            F.max(F.when(at < F.col("_a"), at)).alias("_h0"), F.max(F.when((at >= F.col("_a")) & (at < F.col("_b")), at)).alias("_h1"), F.min(F.when((at > F.col("_b")) & (at <= F.col("_c")), at)).alias("_l3"), F.min(F.when(at > F.col("_c"), at)).alias("_l4"),
        )
        ends, parts = [F.col("_n0"), F.col("_n0") + F.col("_n1"), F.col("_n0") + F.col("_n1") + F.col("_n2"), F.col("_n0") + F.col("_n1") + F.col("_n2") + F.col("_n3")], []
        for part, (lo, hi) in enumerate((("_lo", "_h0"), ("_a", "_h1"), ("_b", "_b"), ("_l3", "_c"), ("_l4", "_hi"))):
            begun = ends[part - 1] if part else F.lit(0)
            size = (ends[part] if part < 4 else F.col("_m")) - begun
            parts.append((begun, F.struct(F.col(lo).alias("lo"), F.col(hi).alias("hi"), (F.col("_k") - begun).cast("long").alias("k"), size.cast("long").alias("m"))))
        chosen = F.when(F.col("_k") < ends[0], parts[0][1])
        for part in (1, 2, 3):
            chosen = chosen.when(F.col("_k") < ends[part], parts[part][1])
        moved = same(keys, split, counted).withColumn("_new", chosen.otherwise(parts[4][1]))
        targets = kept(moved.select(*keys, "n", F.col("_new.lo").alias("_lo"), F.col("_new.hi").alias("_hi"), F.col("_new.k").alias("_k"), F.col("_new.m").alias("_m")), "targets")


# --- linear recurrences ---------------------------------------------------------------------------


def affine_values(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """From zero, y[i] = a[i] y[i-1] + b[i]; and the products of a: what y is from elsewhere is y + product x start."""
    y, factor = np.empty(len(a)), np.cumprod(a)
    edges = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
    before = 0.0
    for lo, hi in zip(edges, np.append(edges[1:], len(a)), strict=True):  # runs of one factor
        f = a[lo]
        if f == 1.0:
            y[lo:hi] = before + np.cumsum(b[lo:hi])
        elif f == 0.0:
            y[lo:hi] = b[lo:hi]
        else:
            y[lo:hi] = pd.Series(np.concatenate([[before], b[lo:hi] / (1.0 - f)])).ewm(alpha=1.0 - f, adjust=False).mean().to_numpy()[1:]
        before = y[hi - 1]
    return y, factor


def affine(held: DataFrame, maps: dict[str, tuple[str, str]], by: Sequence[str]) -> DataFrame:
    """``held`` (as ``placed`` gives it) with, for each name, y where y[i] = a[i] y[i-1] + b[i] in its key and y is 0 before.

    Maps of that kind are composed in any grouping: a block's rows are scanned from
    zero beside the products of ``a``, the blocks' ends are composed in order, and a
    row's value is its own plus the product times what its block starts from.
    """
    by, names = list(by), list(maps)
    kinds = {f.name: f.dataType.simpleString() for f in held.schema}
    made = [f"{c}_{n}" for n in names for c in ("_y", "_f")]

    def scanned(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("_at", kind="stable")
        found = {}
        for n in names:
            found[f"_y_{n}"], found[f"_f_{n}"] = affine_values(*(rows[c].to_numpy(dtype=float) for c in maps[n]))
        return rows.assign(**found)

    local = kept(held.groupBy(*by, "_block").applyInPandas(scanned, ", ".join([f"`{c}` {kinds[c]}" for c in held.columns] + [f"`{c}` double" for c in made])), "scanned")
    ends = local.groupBy(*by, "_block").agg(*[F.max_by(c, "_at").alias(c) for c in made])

    def composed(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("_block")
        found = {}
        for n in names:
            starts, now = [], 0.0
            for y, f in zip(rows[f"_y_{n}"], rows[f"_f_{n}"], strict=True):
                starts.append(now)
                now = y + f * now
            found[f"_s_{n}"] = starts
        return rows[[*by, "_block"]].assign(**found)

    starts = ends.groupBy(*by).applyInPandas(composed, ", ".join([*[f"`{c}` {kinds[c]}" for c in by], "_block long", *[f"`_s_{n}` double" for n in names]]))
    met = same([*by, "_block"], local, starts)
    return met.select(*held.columns, *[(F.col(f"_y_{n}") + F.col(f"_f_{n}") * F.col(f"_s_{n}")).alias(n) for n in names])


def smoothed(held: DataFrame, columns: dict[str, tuple[str, int, float]], by: Sequence[str], i: str) -> DataFrame:
    """For each name (value, n, alpha): the mean of the first n values at place n - 1, then smoothed by alpha; null before. ``i`` counts the values of a key from 0."""
    ready = held
    for name, (x, n, alpha) in columns.items():
        first = F.col(i) < n
        ready = ready.withColumn(f"_a_{name}", F.when(first, F.lit(1.0)).otherwise(F.lit(1.0 - alpha)))
        ready = ready.withColumn(f"_b_{name}", F.when(F.col(i) < 0, F.lit(0.0)).when(first, F.col(x) / n).otherwise(F.col(x) * alpha))
    out = affine(ready, {f"_o_{n}": (f"_a_{n}", f"_b_{n}") for n in columns}, by)
    return out.select(*held.columns, *[F.when(F.col(i) >= n - 1, F.col(f"_o_{name}")).alias(name) for name, (_, n, _) in columns.items()])


def series(df: DataFrame, x: str, by: Sequence[str], order: Sequence[str], rows: int = ROWS) -> DataFrame:
    """``by, order, x, i, step``: values of each key in order, their place from 0 and their change (null at first)."""
    held = placed(df.select(*by, *order, F.col(x).cast("double").alias("x")), [*by, *order], rows)
    out = running(held, {"i": F.lit(1)}, by, {"_old": "x"})
    return kept(out.withColumn("i", F.col("i").cast("long")).withColumn("step", F.col("x") - F.col("_old")).drop("_old"), "series")


def ema(held: DataFrame, n: int, by: Sequence[str]) -> DataFrame:
    """``held`` (as ``series`` gives it) with ``ema``: the mean of the first n values, then smoothed by 2 / (n + 1)."""
    return smoothed(held, {"ema": ("x", n, 2.0 / (n + 1))}, by, "i")


def rsi_wilder(held: DataFrame, n: int, by: Sequence[str]) -> DataFrame:
    """With ``rsi``, 0 to 100: null for the first n values, 100 where no loss is left."""
    steps = held.withColumn("_g", F.coalesce(F.greatest("step", F.lit(0.0)), F.lit(0.0))).withColumn("_d", F.coalesce(F.greatest(-F.col("step"), F.lit(0.0)), F.lit(0.0))).withColumn("_j", F.col("i") - 1)
    out = smoothed(steps, {"_up": ("_g", n, 1.0 / n), "_down": ("_d", n, 1.0 / n)}, by, "_j")
    rsi = F.when(F.col("_down") == 0, F.lit(100.0)).otherwise(100.0 - 100.0 / (1.0 + F.col("_up") / F.col("_down")))
    return out.select(*held.columns, F.when(F.col("i") >= n, rsi).alias("rsi"))


def macd(held: DataFrame, fast: int, slow: int, signal: int, by: Sequence[str]) -> DataFrame:
    """With ``macd, signal, histogram``; the signal smooths the line from its first value on."""
    both = smoothed(held, {"_fast": ("x", fast, 2.0 / (fast + 1)), "_slow": ("x", slow, 2.0 / (slow + 1))}, by, "i")
    line = both.withColumn("macd", F.col("_fast") - F.col("_slow")).withColumn("_v", F.coalesce("macd", F.lit(0.0))).withColumn("_j", F.col("i") - (max(fast, slow) - 1)).drop("_fast", "_slow")
    out = smoothed(line, {"signal": ("_v", signal, 2.0 / (signal + 1))}, by, "_j")
    return out.select(*held.columns, "macd", "signal", (F.col("macd") - F.col("signal")).alias("histogram"))
