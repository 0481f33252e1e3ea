"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _digest(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def _apart(column: str):
    """A one-to-one image of a node id: joins on it get a shuffle of their own, whose hot partitions can be split."""
    return F.col(column).bitwiseXOR(F.lit(0x5DEECE66D))


def connected(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``node, root`` for every node of ``edges`` (``a, b`` longs); root is the least node reachable.

    A round links every larger neighbour of a node to the node's least neighbour
    (large star), then every smaller one too (small star); the rounds needed grow
    with the logarithm of the longest chain. Rounds are tables in the scratch
    folder, so neither lineage nor driver memory grows. Self-links and repeated
    links are harmless; no edges give no rows.
    """
    now = written(
        edges.where("a <> b").select(F.greatest("a", "b").alias("b"), F.least("a", "b").alias("a")).select("a", "b").distinct(), "edges"
    )
    before = None
    for _ in range(max_rounds):
        if (state := _digest(now)) == before or state[0] == 0:
            return now.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(
                now.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct()
            )
        before = state
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = now.join(least, _apart("a") == _apart("u")).select(F.col("b").alias("x"), F.col("m").alias("y")).distinct()
        large = written(large, "large")
        low = large.groupBy("x").agg(F.min("y").alias("m")).withColumnRenamed("x", "u")
        moved = large.join(low, _apart("x") == _apart("u")).where("y <> m").select(F.col("m").alias("a"), F.col("y").alias("b"))
        kept = low.select(F.col("m").alias("a"), F.col("u").alias("b"))
        now = written(moved.unionByName(kept).distinct(), "edges")
    raise RuntimeError(f"components did not settle within {max_rounds} rounds")
