"""Exact duplicates by composable polynomial fingerprints, proven chunk by chunk."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import named, text_or_empty, written

#: A text is the polynomial of its UTF-8 bytes at 256, taken modulo each of two primes.
#: Both are safe primes, so the powers of 256 do not repeat within any real text.
#: Two texts of different content agree in both with a chance of about length / 2^122.
PRIMES = (2305843009213691579, 2305843009213690799)
#: Bytes folded at a time within a task.
CHUNK_BYTES = 4096
#: A text of more bytes is cut into segments that are hashed in parallel.
SEGMENT_BYTES = 1 << 20


def combine(left: tuple[int, int], right: tuple[int, int], prime: int) -> tuple[int, int]:
    """(hash, bytes) of two adjoining parts: the left one is shifted by the right one's length."""
    return (left[0] * pow(256, right[1], prime) + right[0]) % prime, left[1] + right[1]


def fingerprint(data: bytes, prime: int, chunk: int = CHUNK_BYTES) -> tuple[int, int]:
    """The polynomial hash of ``data``, combined from hashes of its chunks."""
    parts = ((int.from_bytes(data[i : i + chunk], "big") % prime, len(data[i : i + chunk])) for i in range(0, len(data), chunk))
    return reduce(lambda a, b: combine(a, b, prime), parts, (0, 0))


def _hashed(texts: pd.Series, primes: tuple[int, ...]) -> pd.DataFrame:
    rows = []
    for t in texts:
        data = t if isinstance(t, bytes) else t.encode("utf-8", "surrogatepass")
        rows.append((fingerprint(data, primes[0])[0], fingerprint(data, primes[1])[0]))
    return pd.DataFrame(rows, columns=["f0", "f1"], dtype="int64")


def _segment_hash(primes: tuple[int, ...]):
    @F.pandas_udf("f0 long, f1 long")
    def hashed(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in parts:
            yield _hashed(texts, primes)

    return hashed


def _segment_fold(primes: tuple[int, ...]):
    @F.pandas_udf("f0 long, f1 long")
    def folded(lists: pd.Series) -> pd.DataFrame:
        rows = []
        for parts in lists:
            ordered = sorted(parts, key=lambda p: p["seg"])
            rows.append(
                [reduce(lambda a, b, q=q: combine(a, b, q), ((p[f"f{k}"], p["n"]) for p in ordered), (0, 0))[0] for k, q in enumerate(primes)]
            )
        return pd.DataFrame(rows, columns=["f0", "f1"], dtype="int64")

    return folded


def _pieces(data: Column, size: int) -> Column:
    """Binary data in pieces of so many bytes, each cut out without reading what is before it; empty data has one piece."""
    last = F.greatest(F.ceil(F.octet_length(data) / F.lit(size)) - 1, F.lit(0))
    return F.transform(F.sequence(F.lit(0).cast("long"), last.cast("long")), lambda i: F.substring(data, (i * size + 1).cast("int"), F.lit(size)))


def fingerprints(rows: DataFrame, primes: tuple[int, ...] = PRIMES, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """``_id, _sha, _n, f0, f1`` for rows of ``_id, _text``, one per row.

    Texts of ordinary length are hashed where they are read. A huge one is cut
    into segments that are dealt out, hashed apart and combined in order; rows
    that repeat in both id and text are hashed once and counted.
    """
    digest = rows.select("_id", "_text", F.sha2(F.col("_text"), 256).alias("_sha"), F.octet_length("_text").cast("long").alias("_n"))
    is_huge = F.octet_length("_text") > segment_bytes
    usual = digest.where(~is_huge).withColumn("_f", _segment_hash(primes)(F.col("_text"))).select("_id", "_sha", "_n", "_f.f0", "_f.f1")
    parts = (
        digest.where(is_huge)
        .select("_id", "_sha", "_n", F.posexplode(_pieces(F.col("_text").cast("binary"), segment_bytes)).alias("_seg", "_part"))
        .repartition("_sha", "_seg")
        .withColumn("_f", _segment_hash(primes)(F.col("_part")))
        .groupBy("_id", "_sha", "_n", "_seg")
        .agg(F.min("_f.f0").alias("f0"), F.min("_f.f1").alias("f1"), F.min(F.octet_length("_part")).alias("n"), F.count(F.lit(1)).alias("_copies"))
        .groupBy("_id", "_sha", "_n")
        .agg(F.collect_list(F.struct(F.col("_seg").alias("seg"), "f0", "f1", "n")).alias("_parts"), F.min("_copies").alias("_copies"))
        .withColumn("_f", _segment_fold(primes)(F.col("_parts")))
        .select("_id", "_sha", "_n", "_f.f0", "_f.f1", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies"))).alias("_copy"))
        .drop("_copy")
    )
    return usual.unionByName(parts)


def _colliding(rows: DataFrame, shared: DataFrame, chunk: int) -> DataFrame:
    """Shared fingerprints of texts that differ, found by comparing chunk with chunk.

    ``shared`` has ``_sha, f0, f1, _n``: which texts to compare with which. All
    members of a group must have the same chunk at each place. A task folds its
    own copies first, so a group of any size sends one row per task and place;
    texts that share their fingerprint with none stay where they are, and no text
    leaves the JVM.
    """
    members = rows.select(F.sha2("_text", 256).alias("_sha"), F.col("_text").cast("binary").alias("_data")).join(shared, "_sha")
    places = members.select("f0", "f1", "_n", F.posexplode(_pieces(F.col("_data"), chunk)).alias("_place", "_chunk"))
    return (
        places.groupBy("f0", "f1", "_n", "_place", "_chunk").agg(F.count(F.lit(1)).alias("_c"))
        .groupBy("f0", "f1", "_n", "_place").agg(F.count(F.lit(1)).alias("_kinds"))
        .where("_kinds > 1").select("f0", "f1", "_n").distinct()
    )


def exact_dedup(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    primes: tuple[int, ...] = PRIMES,
    segment_bytes: int = SEGMENT_BYTES,
    chunk_bytes: int = 1 << 16,
    broadcast_groups: int = 200_000,
) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when they are identical; null counts as empty, and empty
    texts are one group. Of equal texts the largest id stays; where that id
    itself is repeated with the same text, every such row is marked as kept,
    for the rows can't be told apart. A null id never outranks another. An empty
    table gives an empty result. Only id and text are read.

    Fingerprints propose groups; a chunkwise comparison of the whole texts proves
    them, and any group whose texts differ is grouped again by the texts.
    ``broadcast_groups`` bounds the texts' keys (90 bytes) that are broadcast for
    that comparison; beyond it the join is shuffled. Texts of any length are read
    whole, in segments.
    """
    rows = df.select(named(id_col).alias("_id"), text_or_empty(text_col).alias("_text"))
    prints = written(fingerprints(rows, primes, segment_bytes), "prints")
    groups = written(
        prints.groupBy("f0", "f1", "_n").agg(F.max("_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")).where("group_size > 1"), "groups"
    )
    keys = groups.select("f0", "f1", "_n")
    shared = written(prints.select("_sha", "f0", "f1", "_n").distinct().join(keys, ["f0", "f1", "_n"], "left_semi"), "shared")
    bad = written(_colliding(rows, F.broadcast(shared) if shared.count() <= broadcast_groups else shared, chunk_bytes), "bad")
    found = _with_group(prints, groups, ["f0", "f1", "_n"])
    if not bad.isEmpty():
        again = rows.withColumn("_f", _segment_hash(primes)(F.col("_text")))
        again = again.select("_id", "_text", F.sha2("_text", 256).alias("_sha"), F.octet_length("_text").cast("long").alias("_n"), "_f.f0", "_f.f1")
        again = again.join(bad, ["f0", "f1", "_n"], "left_semi").select("_id", "_text", "_sha")
        by_text = again.groupBy("_text").agg(F.max("_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        found = _with_group(prints.join(bad, ["f0", "f1", "_n"], "left_anti"), groups, ["f0", "f1", "_n"]).unionByName(_with_group(again, by_text, ["_text"]))
    return found


def _with_group(rows: DataFrame, groups: DataFrame, keys: list[str]) -> DataFrame:
    """Each row's group; rows without one are their own.

    The join is an outer join of two plain shuffles, so adaptive execution can
    split the partition of a group that holds a large share of all rows.
    """
    held = rows.join(groups, keys, "left")
    keep = F.when(F.col("group_size").isNull(), F.col("_id")).otherwise(F.col("keep_id"))
    return held.select(
        F.col("_id").alias("doc_id"),
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("_id").eqNullSafe(keep).alias("kept"),
        F.col("_sha").alias("text_sha256"),
    )
