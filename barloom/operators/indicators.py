"""Indicators over a series as window expressions.

Each function gives a Column; all that share a Series share one sort. A value is
NULL until its window is full.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec


@dataclass(frozen=True)
class Series:
    """How a table is cut into series and ordered; ``i`` counts from 0 within each."""

    by: tuple[str, ...] = ("symbol",)
    i: str = "i"

    @property
    def all(self) -> WindowSpec:
        return Window.partitionBy(*self.by).orderBy(self.i)

    def rows(self, back: int, to: int = 0) -> WindowSpec:
        return self.all.rowsBetween(back, to)

    def last(self, n: int) -> WindowSpec:
        return self.rows(1 - n)

    def full(self, n: int, value: Column) -> Column:
        return F.when(F.col(self.i) >= n - 1, value)

    def lag(self, value: Column | str, n: int = 1) -> Column:
        return F.lag(value, n).over(self.all)

    def lead(self, value: Column | str, n: int = 1) -> Column:
        return F.lead(value, n).over(self.all)


MARKET = Series()


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def sma(x: Column | str, n: int, s: Series = MARKET) -> Column:
    """Mean of the last n values; NULL for n < 1."""
    return s.full(n, F.avg(x).over(s.last(n))) if n >= 1 else F.lit(None).cast("double")


def ma_cross(x: Column | str, short: int, long: int, s: Series = MARKET) -> Column:
    """Short mean less long mean, current bar included."""
    return s.full(long, F.avg(x).over(s.last(short)) - F.avg(x).over(s.last(long)))


def slope(x: Column | str, n: int, s: Series = MARKET) -> Column:
    """Least-squares slope over the last n values."""
    return s.full(n, F.regr_slope(_col(x), F.col(s.i).cast("double")).over(s.last(n)))


def with_true_range(df: DataFrame, high: str, low: str, close: str, s: Series = MARKET) -> DataFrame:
    """``df`` with ``_tr`` (true range) and ``_hl`` (high less low), which ATR windows sum."""
    before = s.lag(close)
    h, lo = F.col(high), F.col(low)
    return df.withColumn("_hl", h - lo).withColumn("_tr", F.greatest(h - lo, h - before, before - lo))


def atr_of(n: int, s: Series = MARKET) -> Column:
    """ATR over a table that has ``_tr`` and ``_hl``."""
    if n == 1:
        return F.col("_hl")
    return s.full(n, (F.sum("_tr").over(s.rows(2 - n)) + s.lag("_hl", n - 1)) / n)


def range_expansion(x: Column | str, n: int, s: Series = MARKET) -> Column:
    """Range of the recent half of n values over the range of the older half."""
    half = n // 2
    recent, old = s.rows(-(n - half - 1)), s.rows(-(n - 1), -(n - half))
    spread = lambda w: F.max(x).over(w) - F.min(x).over(w)
    return s.full(n, spread(recent) / (spread(old) + F.lit(1e-10)))


def price_jump(x: Column | str, n: int, s: Series = MARKET) -> Column:
    """The value less an average of the n-1 before it, smoothed by 2/n from the first of them."""
    alpha = 2.0 / n
    before = F.collect_list(x).over(s.rows(-(n - 1), -1))
    mean = F.aggregate(F.slice(before, 2, max(n, 2)), F.element_at(before, 1), lambda a, v: a + (v - a) * alpha)
    return s.full(n, _col(x) - mean)


def versions(df: DataFrame, name: str, make, lookback: int, version: int, s: Series = MARKET) -> DataFrame:
    """An indicator as it is (0), less its value a lookback ago (1), or less its value over version x lookback (2, ...)."""
    if version == 0:
        return df.withColumn(name, make(lookback))
    if version == 1:
        held = df.withColumn("_now", make(lookback))
        return held.withColumn(name, F.col("_now") - s.lag("_now", lookback)).drop("_now")
    return df.withColumn(name, make(lookback) - make(version * lookback))


def with_changes(df: DataFrame, x: str, s: Series = MARKET) -> DataFrame:
    """``df`` with ``_gain`` and ``_loss``, both 0 or more, of the step to each bar."""
    step = _col(x) - s.lag(x)
    return df.withColumn("_gain", F.greatest(step, F.lit(0.0))).withColumn("_loss", F.greatest(-step, F.lit(0.0)))


def rsi_simple(n: int, s: Series = MARKET) -> Column:
    """Plain-mean RSI scaled to [-1, 1], over a table that has ``_gain`` and ``_loss``; 0 without history."""
    gain, loss = F.avg("_gain").over(s.last(n)), F.avg("_loss").over(s.last(n))
    rsi = F.when((gain < 1e-10) & (loss < 1e-10), F.lit(50.0)).when(loss < 1e-10, F.lit(100.0)).otherwise(100 - 100 / (1 + F.try_divide(gain, loss)))
    return F.when(F.col(s.i) >= n, (rsi - 50) / 50).otherwise(F.lit(0.0))


def bollinger(x: Column | str, n: int, width: float, s: Series = MARKET) -> tuple[Column, Column, Column]:
    """(lower, middle, upper): the mean less and plus ``width`` population deviations."""
    mid, dev = F.avg(x).over(s.last(n)), F.stddev_pop(x).over(s.last(n))
    return s.full(n, mid - dev * width), s.full(n, mid), s.full(n, mid + dev * width)


def cci(high: str, low: str, close: str, n: int, s: Series = MARKET) -> Column:
    """Typical price against its mean, in mean deviations from that mean; 0 where these vanish."""
    typical = (F.col(high) + F.col(low) + F.col(close)) / 3
    frame, mean = F.collect_list(typical).over(s.last(n)), F.avg(typical).over(s.last(n))
    dev = F.aggregate(frame, F.lit(0.0), lambda a, v: a + F.abs(v - mean)) / n
    return s.full(n, F.when(dev < 1e-10, F.lit(0.0)).otherwise(F.try_divide(typical - mean, dev * 0.015)))


def stochastic(df: DataFrame, high: str, low: str, close: str, k: int, d: int, s: Series = MARKET) -> DataFrame:
    """``df`` with ``stoch_k`` (place in the k-bar range, 50 where it is flat) and ``stoch_d`` (its d-bar mean)."""
    top, bottom = F.max(high).over(s.last(k)), F.min(low).over(s.last(k))
    value = F.when(top == bottom, F.lit(50.0)).otherwise(F.try_divide(F.col(close) - bottom, top - bottom) * 100)
    held = df.withColumn("stoch_k", s.full(k, value))
    return held.withColumn("stoch_d", s.full(k + d - 1, F.avg("stoch_k").over(s.last(d))))


def obv(df: DataFrame, close: str, volume: str, s: Series = MARKET) -> DataFrame:
    """``df`` with ``obv``: volume summed by the sign of each step, from 0."""
    signed = F.coalesce(F.signum(F.col(close) - s.lag(close)) * F.col(volume), F.lit(0.0))
    return df.withColumn("_signed", signed).withColumn("obv", F.sum("_signed").over(s.rows(Window.unboundedPreceding))).drop("_signed")


def roc(x: Column | str, n: int, s: Series = MARKET) -> Column:
    """Relative change over n bars; NULL from zero."""
    return F.try_divide(_col(x) - s.lag(x, n), s.lag(x, n))


def spec_grid(spark, types: list[str], increment: int, n_long: int, n_short: int) -> DataFrame:
    """``k, type, short_lookback, long_lookback``, types outermost; specs are numbered in that order."""
    kinds = F.explode(F.array(*[F.struct(F.lit(n).alias("t"), F.lit(v).alias("type")) for n, v in enumerate(types)]))
    grid = spark.range(1).select(kinds.alias("_t")).select("_t.*", F.explode(F.sequence(F.lit(0), F.lit(n_long - 1))).alias("a"))
    grid = grid.select("*", F.explode(F.sequence(F.lit(0), F.lit(n_short - 1))).alias("b"))
    long = (F.col("a") + 1) * increment
    short = F.greatest(F.lit(1), F.floor(long * (F.col("b") + 1) / (n_short + 1)).cast("int"))
    k = F.col("t") * (n_long * n_short) + F.col("a") * n_short + F.col("b")
    return grid.select(k.cast("int").alias("k"), "type", short.alias("short_lookback"), long.cast("int").alias("long_lookback"))


def targets(x: Column | str, ahead: int = 1, s: Series = MARKET) -> Column:
    """Change to ``ahead`` bars later."""
    return s.lead(x, ahead) - _col(x)


def clean_tails(df: DataFrame, value: str, tail: float, by: tuple[str, ...] = ("symbol",), legacy: bool = False) -> DataFrame:
    """``df`` with ``cleaned``: values outside the shortest interval that holds 1 - 2 x tail of them are squashed.

    They approach limits a tenth of the interval beyond its ends. ``legacy``
    folds them inside the ends instead, as older results did.
    """
    s = Window.partitionBy(*by).orderBy(value)
    held = df.where(F.col(value).isNotNull())
    n = F.count(F.lit(1)).over(Window.partitionBy(*by))
    span = F.greatest(F.floor(n * (1 - 2 * tail)).cast("int") - 1, F.lit(0))
    ranked = held.withColumn("_r", F.row_number().over(s)).withColumn("_span", span)
    ends = ranked.select(*by, F.col("_r").alias("_r2"), F.col(value).alias("_hi"))
    low = ranked.select(*by, "_r", (F.col("_r") + F.col("_span")).alias("_to"), F.col(value).alias("_lo"))
    low = low.withColumnsRenamed({b: f"_b{b}" for b in by})
    same = F.lit(True)
    for b in by:
        same = same & (F.col(b) == F.col(f"_b{b}"))
    spans = low.join(ends, same & (F.col("_to") == F.col("_r2")))
    best = spans.groupBy(*by).agg(F.min_by(F.struct("_lo", "_hi"), F.struct(F.col("_hi") - F.col("_lo"), "_r")).alias("_best"))
    out = held.join(best, list(by)).withColumn("_w", F.col("_best._hi") - F.col("_best._lo"))
    v, lo, hi, w = F.col(value), F.col("_best._lo"), F.col("_best._hi"), F.greatest(F.col("_w"), F.lit(1e-30))
    reach = w * 0.1
    sign = -1.0 if legacy else 1.0
    under = lo - (1 - F.exp(-(lo - v) / w)) * reach * sign
    over = hi + (1 - F.exp(-(v - hi) / w)) * reach * sign
    return out.withColumn("cleaned", F.when(v < lo, under).when(v > hi, over).otherwise(v)).drop("_best", "_w")


def runs(df: DataFrame, value: str, threshold: Column, s: Series = MARKET) -> DataFrame:
    """``by, above, bucket, n``: lengths of runs at or above, and below, a threshold, in buckets of powers of two up to 512."""
    held = df.where(F.col(value).isNotNull()).withColumn("above", F.col(value) >= threshold)
    fresh = F.coalesce((F.col("above") != s.lag("above")).cast("int"), F.lit(1))
    held = held.withColumn("_new", fresh).withColumn("_run", F.sum("_new").over(s.rows(Window.unboundedPreceding)))
    sizes = held.groupBy(*s.by, "above", "_run").agg(F.count(F.lit(1)).alias("len"))
    bucket = F.when(F.col("len") > 512, F.lit(1024)).otherwise(F.pow(F.lit(2.0), F.ceil(F.log2(F.col("len")))).cast("int"))
    return sizes.groupBy(*s.by, "above", bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
