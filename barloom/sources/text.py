"""Readers of price and bar text, with a policy for bad lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

POLICIES = ("fail", "drop")


NAME_CHARS = 15


def _lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Lines with their file's name as symbol (15 characters at most) and their place in it, ``_at``.

    A file is read in splits, and ``_at`` puts its lines in order again: the
    split's start, then the row's place in the task. Files whose names are the
    same within 15 characters would become one series, so they are refused.
    """
    held = spark.read.text(paths)
    names: dict[str, str] = {}
    for file in sorted(set(held.inputFiles())):
        name = file.rsplit("/", 1)[-1].rsplit(".", 1)[0][:NAME_CHARS]
        if names.setdefault(name, file) != file:
            raise ValueError(f"{names[name]} and {file} have the same market name {name}")
    name = F.regexp_replace(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1), r"\.[^.]*$", "")
    place = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    return held.select(F.substring(name, 1, NAME_CHARS).alias("symbol"), F.col("_metadata.file_path").alias("_file"), place.alias("_at"), F.col("value"))


def _parts(value: Column) -> Column:
    return F.split(F.trim(value), r"[ \t,]+")


def _day(text: Column) -> Column:
    """The date of eight digits, or null where they are none or lie outside 1800 to 2030."""
    day = F.try_to_timestamp(F.substring(text, 1, 8), F.lit("yyyyMMdd")).cast("date")
    return F.when(text.rlike(r"^\d{8}") & F.year(day).between(1800, 2030), day)


def valid_bar(o: Column, h: Column, lo: Column, c: Column) -> Column:
    """Prices above zero, the low not above open or close, the high not below them."""
    return (o > 0) & (h > 0) & (lo > 0) & (c > 0) & (lo <= o) & (lo <= c) & (h >= o) & (h >= c)


def _apply(df: DataFrame, good: Column, policy: str, what: str) -> DataFrame:
    if policy not in POLICIES:
        raise ValueError(f"policy must be one of {POLICIES}")
    if policy == "drop":
        return df.where(F.coalesce(good, F.lit(False)))
    checked = F.when(F.coalesce(good, F.lit(False)), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit(f"{what}: "), F.col("value"))))
    return df.where(checked)


def read_bars(spark: SparkSession, paths: str | list[str], policy: str = "fail", log: bool = True, ascending: bool = True, lenient: bool = False, to_blank: bool = False) -> DataFrame:
    """``symbol, dt, i, open, high, low, close[, x]`` from ``YYYYMMDD O H L C`` lines.

    Blank lines are skipped, or with ``to_blank`` end their file. ``fail`` raises
    at a bad line and, with ``ascending``, at a date that is not after all the dates
    before it in the file; ``drop`` leaves such lines out. ``lenient`` fills missing
    prices from the open.
    """
    held = _lines(spark, paths)
    blank = F.trim("value") == ""
    if to_blank:
        held = held.withColumn("_stop", F.min(F.when(blank, F.col("_at"))).over(Window.partitionBy("_file"))).where(F.col("_stop").isNull() | (F.col("_at") < F.col("_stop")))
    held = held.where(~blank)
    p = _parts(F.col("value"))
    price = lambda k: F.expr(f"try_cast(get(_p, {k}) AS DOUBLE)")
    held = held.withColumn("_p", p).withColumn("dt", _day(F.col("value"))).withColumn("open", price(1))
    for k, name in enumerate(("high", "low", "close"), 2):
        held = held.withColumn(name, F.coalesce(price(k), F.col("open")) if lenient else price(k))
    good = F.col("dt").isNotNull() & valid_bar(F.col("open"), F.col("high"), F.col("low"), F.col("close"))
    held = _apply(held, good, policy, "bad bar")
    if ascending:
        before = F.max("dt").over(Window.partitionBy("_file").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1))
        held = _apply(held.withColumn("_before", before), F.col("_before").isNull() | (F.col("dt") > F.col("_before")), policy, "dates must increase")
    order = Window.partitionBy("symbol").orderBy("dt", "_at")
    out = held.withColumn("i", F.row_number().over(order) - 1).select("symbol", "dt", "i", "open", "high", "low", "close")
    return out.withColumn("x", F.log("close")) if log else out


def read_prices(spark: SparkSession, paths: str | list[str], policy: str = "fail", log: bool = True, last_column: bool = False, keep_raw: bool = False) -> DataFrame:
    """``symbol, dt, i, price[, x]`` from ``YYYYMMDD price`` lines.

    ``last_column`` takes the last token instead of the first after the date;
    ``keep_raw`` keeps prices at or below zero, whose log is null.
    """
    held = _lines(spark, paths).where(F.trim("value") != "").withColumn("_p", _parts(F.col("value")))
    held = held.withColumn("dt", _day(F.col("value")))
    held = held.withColumn("price", F.expr("try_cast(element_at(_p, -1) AS DOUBLE)" if last_column else "try_cast(get(_p, 1) AS DOUBLE)"))
    good = F.col("dt").isNotNull() & F.col("price").isNotNull() & (F.lit(True) if keep_raw else F.col("price") > 0)
    held = _apply(held, good, policy, "bad price")
    out = held.withColumn("i", F.row_number().over(Window.partitionBy("symbol").orderBy("dt")) - 1).select("symbol", "dt", "i", "price")
    return out.withColumn("x", F.when(F.col("price") > 0, F.log("price"))) if log else out


def read_markets(spark: SparkSession, list_path: str, **kw) -> DataFrame:
    """Bars of every file that a list names, one a line; the symbol is the file's name."""
    names = [r.value.strip() for r in spark.read.text(list_path).collect() if r.value.strip() and not r.value.lstrip().startswith("#")]
    return read_bars(spark, names, **kw)


def save_market_list(spark: SparkSession, bars: DataFrame, folder: str, path: str) -> None:
    """The list of market files that ``read_markets`` takes: ``folder``/SYMBOL.TXT for each series, one a line."""
    held = bars.select("symbol").distinct().select(F.concat(F.lit(folder.rstrip("/") + "/"), F.col("symbol"), F.lit(".TXT")).alias("value"))
    held.coalesce(1).sortWithinPartitions("value").write.mode("overwrite").text(path)


def read_vendor_csv(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``symbol, dt, open, high, low, close`` from ``Date,Open,High,Low,Close`` files; days are UTC, rows with gaps go."""
    held = spark.read.option("header", True).csv(paths).select("*", F.col("_metadata.file_path").alias("_file"))
    name = F.regexp_replace(F.element_at(F.split("_file", "/"), -1), r"\.[^.]*$", "")
    number = lambda c: F.expr(f"try_cast(`{c}` AS DOUBLE)").alias(c.lower())
    day = F.coalesce(F.expr("try_cast(Date AS TIMESTAMP)"), F.try_to_timestamp("Date", F.lit("yyyy-MM-dd"))).cast("date")
    return held.select(name.alias("symbol"), day.alias("dt"), *[number(c) for c in ("Open", "High", "Low", "Close")]).dropna()


def read_broker_csv(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``symbol, ts, open, high, low, close, volume`` from ``DD.MM.YYYY HH:MM:SS.sss GMT+zzzz,...`` files; short rows go."""
    held = _lines(spark, paths).withColumn("_p", F.split("value", ",")).where(F.size("_p") >= 5)
    stamp = F.regexp_replace(F.expr("get(_p, 0)"), "GMT", "")
    ts = F.coalesce(F.try_to_timestamp(stamp, F.lit("dd.MM.yyyy HH:mm:ss.SSS Z")), F.try_to_timestamp(F.substring(stamp, 1, 19), F.lit("dd.MM.yyyy HH:mm:ss")))
    number = lambda k: F.expr(f"try_cast(get(_p, {k}) AS DOUBLE)")
    out = held.select("symbol", ts.alias("ts"), *[number(k).alias(n) for k, n in enumerate(("open", "high", "low", "close", "volume"), 1)])
    return out.where("ts IS NOT NULL AND close IS NOT NULL")


def bar_text(bars: DataFrame, stamp: str = "dt", decimals: int = 6) -> DataFrame:
    """``symbol, value`` lines ``YYYYMMDD O H L C``."""
    number = lambda c: F.format_string(f"%.{decimals}f", c)
    return bars.select("symbol", F.concat_ws(" ", F.date_format(stamp, "yyyyMMdd"), *[number(F.col(c)) for c in ("open", "high", "low", "close")]).alias("value"))


def write_bar_text(bars: DataFrame, path: str, stamp: str = "dt") -> None:
    """One folder of text a symbol, ascending within it."""
    held = bars.repartition("symbol").sortWithinPartitions("symbol", stamp)
    bar_text(held, stamp).write.mode("overwrite").partitionBy("symbol").text(path)


def price_text(bars: DataFrame) -> DataFrame:
    """``symbol, value`` lines of day and log close."""
    return bars.select("symbol", F.concat_ws(" ", F.date_format("dt", "yyyyMMdd"), F.log("close").cast("string")).alias("value"))


def save_parameters(spark: SparkSession, values: list[float], path: str) -> None:
    """One number a line, four at least."""
    if len(values) < 4:
        raise ValueError("four parameters are needed")
    spark.createDataFrame([(k, repr(float(v))) for k, v in enumerate(values)], "k int, value string").coalesce(1).sortWithinPartitions("k").select("value").write.mode("overwrite").text(path)


def load_parameters(spark: SparkSession, path: str) -> list[float]:
    values = [float(r.value) for r in spark.read.text(path, wholetext=False).collect() if r.value.strip()]
    if len(values) < 4:
        raise ValueError("four parameters are needed")
    return values


def save_text(spark: SparkSession, text: str, path: str) -> None:
    """A report as a text table of one file."""
    spark.createDataFrame([(k, line) for k, line in enumerate(text.split("\n"))], "k int, value string").coalesce(1).sortWithinPartitions("k").select("value").write.mode("overwrite").text(path)
