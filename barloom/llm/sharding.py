"""Weighted rendezvous hashing of stable record keys (native)."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import named

#: Hash values are the first 52 bits of an MD5 digest, so any engine can repeat them.
HASH_BITS = 52


def stable_hash(key: Column, salt: str) -> Column:
    """A 52-bit hash of ``key`` (as text; null counts as empty) and ``salt``."""
    text = F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(f":{salt}"))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long")


def rendezvous(key: Column, shards: Sequence[tuple[int, float]]) -> Column:
    """The shard whose score -weight / ln(u(key, shard)) is the highest.

    Each shard's score depends on the key and that shard alone. So a new shard
    takes over the keys for which it wins and no key moves between old shards;
    a removed shard's keys spread over the others by weight.
    Ties go to the lowest shard number.
    """
    if not shards:
        raise ValueError("at least one shard is needed")
    if any(not w > 0 or math.isinf(w) for _, w in shards):
        raise ValueError("weights must be positive and finite")
    span = float(2**HASH_BITS)
    scored = [
        F.struct(
            (F.lit(-float(weight)) / F.log((stable_hash(key, str(shard)) + F.lit(0.5)) / F.lit(span))).alias("score"),
            F.lit(-int(shard)).alias("order"),
        )
        for shard, weight in shards
    ]
    best = scored[0] if len(scored) == 1 else F.greatest(*scored)
    return (-best["order"]).cast("int")


def shard_rows(
    df: DataFrame,
    key: str,
    shards: Sequence[tuple[int, float]],
    shard_col: str = "shard",
) -> DataFrame:
    """``df`` with a column ``shard_col``: one narrow projection, no shuffle.

    Null keys count as the empty text, equal keys share a shard, an empty table
    stays empty, and a column already called ``shard_col`` is replaced.
    """
    return df.withColumn(shard_col, rendezvous(F.col(key), shards))


#: Equal rows of a task that are counted as one row of the numbering.
RUN_BITS = 12


def number_slots(df: DataFrame, shard_col: str, key: str, ties: Sequence[str], rows: int, n_shards: int, per_bucket: int = 2048) -> DataFrame:
    """Gapless slots from 0 in each shard, without a shard or a key ever meeting in one task.

    A shard is cut into buckets by a second hash of the key; rows are numbered in
    their bucket and moved up by the rows of the buckets before it. ``rows`` is
    the table's count and sets only how many buckets there are. Equal rows are
    counted first, in runs of 4,096 at most, so the window over a bucket sees a
    row for each run, and a run becomes rows again in a task of its own: a key
    may hold a third of all rows. Equal rows take slots in any order, for they
    can't be told apart.
    """
    buckets = max(1, math.ceil(rows / (n_shards * per_bucket)))
    bucket = (stable_hash(F.col(key), "slot") % F.lit(buckets)).cast("long")
    runs = df.withColumn("_run", F.shiftright(F.monotonically_increasing_id(), RUN_BITS)).groupBy(*df.columns, "_run").agg(F.count(F.lit(1)).alias("_c"))
    runs = runs.withColumn("_bucket", bucket)
    sizes = runs.groupBy(F.col(shard_col).alias("_s"), F.col("_bucket").alias("_b")).agg(F.sum("_c").alias("_n"))
    before = Window.partitionBy("_s").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_s", "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(shard_col, "_bucket").orderBy(key, *ties, "_run").rowsBetween(Window.unboundedPreceding, -1)
    numbered = runs.withColumn("_rank", F.coalesce(F.sum("_c").over(inside), F.lit(0)))
    placed = numbered.join(starts, (F.col(shard_col) == F.col("_s")) & (F.col("_bucket") == F.col("_b"))).withColumn("_first", F.col("_start") + F.col("_rank"))
    single = placed.where("_c = 1").select(*df.columns, F.col("_first").cast("long").alias("slot"))
    many = placed.where("_c > 1").repartition(key, "_run")
    return single.unionByName(many.select(*df.columns, F.explode(F.sequence(F.col("_first"), F.col("_first") + F.col("_c") - 1)).alias("slot")))


def shard_manifest(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_shards: int = 16) -> DataFrame:
    """Where each document goes, now and when one more shard is added.

    One row per input row: id, ``size`` (UTF-8 bytes of the text, none for null,
    plus 1), ``text_crc32`` (null counts as empty), ``law`` ("key"), ``shard``,
    ``slot`` and ``grown_shard``. A null id hashes as the empty text; repeated
    rows stay and take slots of their own; equal texts need not meet. Texts of
    any length are read whole and never leave the scan: only the digest columns
    are shuffled. Other columns are not read; an empty table gives an empty result.
    """
    now = [(s, 1.0) for s in range(n_shards)]
    grown = [(s, 1.0) for s in range(n_shards + 1)]
    text = named(text_col).cast("string")
    digest = documents.select(
        named(id_col).alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1).alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
        rendezvous(named(id_col), now).alias("shard"),
        rendezvous(named(id_col), grown).alias("grown_shard"),
    )
    slots = number_slots(digest, "shard", "doc_id", ("text_crc32", "size"), documents.count(), n_shards)
    return slots.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
