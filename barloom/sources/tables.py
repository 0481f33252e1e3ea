"""Market data from warehouse tables: bars, ticks and series with an explicit time axis."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, *by: str) -> DataFrame:
    """``df`` dealt over all shuffle partitions, for work that costs far more than its rows' bytes tell."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def indexed(bars: DataFrame, by: str = "symbol", order: str = "dt") -> DataFrame:
    """``bars`` with ``i`` (0-based place in its series) and ``x`` (log close).

    A series of bars is bounded by calendar time, so one window partition a
    series is small; ticks are folded to bars before they ever meet a window.
    """
    place = Window.partitionBy(by).orderBy(order)
    return bars.where("close > 0").withColumn("i", F.row_number().over(place) - 1).withColumn("x", F.log("close"))


def daily_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by priority and day as bars; the open and close are the lowest and highest order keys' prices."""
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("symbol"), F.col("o_orderdate").cast("date").alias("dt"), F.col("o_totalprice").alias("p"), F.col("o_orderkey").alias("k")
    )
    return orders.groupBy("symbol", "dt").agg(
        F.min_by("p", "k").alias("open"),
        F.max("p").alias("high"),
        F.min("p").alias("low"),
        F.max_by("p", "k").alias("close"),
        F.count(F.lit(1)).cast("double").alias("volume"),
    )


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars with time axis and log prices."""
    held = indexed(daily_bars(spark, sf_dir))
    return held.select("*", F.log("open").alias("lo"), F.log("high").alias("lh"), F.log("low").alias("ll"))


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as ticks: type is the symbol, value the price, one unit each."""
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), F.col("value").alias("price"), F.lit(1.0).alias("volume")
    )
