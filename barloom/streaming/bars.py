"""Ticks to one-minute bars, as a stream and as a batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A trade's keys differ by case alone (s, S), so it is read as a map.
MESSAGE = "struct<type: string, data: array<map<string, string>>>"


def parse_trades(messages: DataFrame, value: str = "value") -> DataFrame:
    """``symbol, seq, price, volume, side, ts`` from JSON trade messages; unreadable numbers become 0.

    Only snapshots and deltas hold trades: confirmations, pings and lines that are
    no JSON give no row. ``seq`` is the trade's number (``i``) or else its time.
    """
    rows = messages.select(F.from_json(F.col(value).cast("string"), MESSAGE).alias("m")).where("m.type IN ('snapshot', 'delta')").select(F.explode("m.data").alias("t"))
    number = lambda k: F.coalesce(F.expr(f"try_cast(t['{k}'] AS DOUBLE)"), F.lit(0.0))
    whole = lambda k: F.expr(f"try_cast(t['{k}'] AS BIGINT)")
    held = rows.select(F.expr("t['s']").alias("symbol"), F.coalesce(whole("i"), whole("T")).alias("seq"), number("p").alias("price"), number("v").alias("volume"), F.expr("t['S']").alias("side"), whole("T").alias("ms"))
    return held.withColumn("ts", F.timestamp_millis("ms")).drop("ms")


def minute_bars(ticks: DataFrame, width: str = "1 minute", late: str | None = None, counted: bool = False) -> DataFrame:
    """``symbol, ts, open, high, low, close, volume`` of each symbol and minute.

    All parts are mergeable aggregates, folded per task before the shuffle, so
    one busy symbol costs a row a task and minute. With ``late``, a stream's bars
    come out once the watermark passes them, each exactly once. ``counted`` adds
    ``n``, the trades that a bar holds.
    """
    held = ticks.withColumn("ts", F.col("ts").cast("timestamp"))
    held = held.withWatermark("ts", late) if late else held
    order = F.struct("ts", "seq")
    out = held.groupBy(F.window("ts", width), "symbol").agg(
        F.min_by("price", order).alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", order).alias("close"),
        F.sum("volume").alias("volume"),
        *([F.count(F.lit(1)).alias("n")] if counted else []),
    )
    return out.select("symbol", F.col("window.start").alias("ts"), "open", "high", "low", "close", "volume", *(["n"] if counted else []))


def tick_stream(spark: SparkSession, path: str, schema: T.StructType, files: int = 8) -> DataFrame:
    """Parquet files as a stream, a bounded number a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


#: The symbol of a row that only moves the watermark past the last real tick.
END = "\x00end"


def closed(ticks: DataFrame, beyond: str = "1 day") -> DataFrame:
    """``ticks`` of a finished replay with one more row, so far behind the last that every real window closes.

    The row's own window never closes, so it is in no output.
    """
    last = ticks.agg(F.max("ts").alias("ts")).where("ts IS NOT NULL").select(F.lit(END).alias("symbol"), (F.col("ts") + F.expr(f"INTERVAL {beyond}")).alias("ts"))
    return ticks.unionByName(last, allowMissingColumns=True)


def write_bars(bars: DataFrame, path: str, checkpoint: str, once: bool = True):
    """Append closed bars by symbol; a restart goes on where the checkpoint stands. ``once``: ends with what is there now."""
    held = bars.writeStream.format("parquet").partitionBy("symbol").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return held.trigger(availableNow=True).start() if once else held.start()


def late_trades(ticks: DataFrame, bars: DataFrame, width: str = "1 minute") -> DataFrame:
    """``symbol, ts, kept, late``: of each symbol and minute with a trade that came after its bar was closed, how many the bar holds and how many not.

    ``ticks`` are all trades as they were stored, ``bars`` the stream's with their
    counts ``n``; both are folded before they meet. A minute whose trades were all
    late has no bar.
    """
    seen = ticks.groupBy("symbol", F.window(F.col("ts").cast("timestamp"), width).start.alias("ts")).agg(F.count(F.lit(1)).alias("all"))
    met = seen.join(bars.select("symbol", "ts", "n"), ["symbol", "ts"], "left").withColumn("kept", F.coalesce("n", F.lit(0)).cast("long"))
    return met.withColumn("late", F.col("all") - F.col("kept")).where("late > 0").select("symbol", "ts", "kept", "late")


def write_ticks(ticks: DataFrame, path: str, checkpoint: str):
    """Append raw ticks as CSV by symbol."""
    return ticks.writeStream.format("csv").partitionBy("symbol").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
