"""SimHash near-duplicates through an inverted index of positional bytes."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import boxed, named, unboxed, written
from .components import connected

BITS, BYTES = 64, 8
SHINGLE_WORDS, MAX_BITS = 3, 2
#: Two fingerprints that differ in so many bits agree in all but as many bytes.
MIN_BYTES = BYTES - MAX_BITS
#: The eight byte positions in four pairs; a posting names the bytes of two pairs.
POSTINGS = tuple(combinations(range(4), 2))


def fingerprint(text: str | None, words: int = SHINGLE_WORDS) -> int:
    """The unsigned 64-bit SimHash of a text; 0 for one without a word."""
    import xxhash

    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return 0
    if len(found) < words:
        shingles = [b" ".join(found)]
    else:
        shingles = map(b" ".join, zip(*(found[k:] for k in range(words)), strict=False))
    digest = xxhash.xxh64_intdigest
    return majority(np.array([digest(s, 42) for s in shingles], dtype=np.uint64))


def majority(hashes: np.ndarray) -> int:
    """The unsigned SimHash of 64-bit hashes: the bits that are set in over half of them."""
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 14):  # bounded memory for texts of any length
        ones += np.unpackbits(hashes[at : at + (1 << 14)].astype(">u8", casting="unsafe").view(np.uint8).reshape(-1, BYTES), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _fingerprints(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = pa.array([_signed(fingerprint(t, words)) for t in batch.column(1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), marks], names=["doc_id", "fp"])

    return run


def simhashes(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS) -> DataFrame:
    """``doc_id, fp`` (the fingerprint as a signed long), one row per input row."""
    held = documents.select(named(id_col).cast("long").alias("doc_id"), named(text_col).cast("string").alias("_text"))
    return held.mapInArrow(_fingerprints(words), "doc_id long, fp long")


def _byte(x: Column, k: int) -> Column:
    return F.shiftright(x, 8 * k).bitwiseAND(F.lit(255).cast("long"))


def shared_bytes(a: Column, b: Column) -> Column:
    """The tally of positions at which two fingerprints have the same byte."""
    differ = a.bitwiseXOR(b)
    return sum((F.when(_byte(differ, k) == 0, 1).otherwise(0) for k in range(BYTES)), F.lit(0))


def _postings(fps: DataFrame) -> DataFrame:
    """``_p, _k, fp``: each fingerprint under each of its six postings of four positional bytes."""
    pair = lambda g: F.shiftright(F.col("fp"), 16 * g).bitwiseAND(F.lit(65535).cast("long"))
    rows = [F.struct(F.lit(i).alias("_p"), F.shiftleft(pair(g), 16).bitwiseOR(pair(h)).alias("_k")) for i, (g, h) in enumerate(POSTINGS)]
    return fps.select("fp", F.explode(F.array(*rows)).alias("_r")).select("_r._p", "_r._k", "fp")


def links(fps: DataFrame, max_bits: int = MAX_BITS, most: int = 64) -> DataFrame:
    """Pairs ``a, b`` of distinct fingerprints that join all which differ in at most two bits.

    Postings of one byte hold 1/256 of all fingerprints whatever their number,
    so counting pairs in them is quadratic. At least six of eight bytes agree
    in a link, hence two of the four byte pairs do: postings name four bytes
    (2^32 values each), and no link is lost. Pairs of a posting are tallied,
    kept at six shared bytes and verified by their differing bits.

    Postings with over ``most`` members emit no pairs. Their members are linked
    exactly through the 64 fingerprints one bit away and their own: two differ in
    at most two bits if and only if they share one of these. Each is linked to
    the least that shares it, so work and rows stay linear, and any two that
    differ in two bits or fewer end up connected.
    """
    if max_bits != MAX_BITS:
        raise ValueError("the index is laid out for two differing bits")
    index = _postings(fps)
    sizes = written(index.groupBy("_p", "_k").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1"), "postings")
    members = written(index.join(sizes, ["_p", "_k"]), "members")
    light = members.where(F.col("_n") <= most)
    a, b = light.select("_p", "_k", F.col("fp").alias("a")), light.select("_p", "_k", F.col("fp").alias("b"))
    candidates = a.join(b, ["_p", "_k"]).where("a < b").select("a", "b")
    tallied = candidates.where(shared_bytes(F.col("a"), F.col("b")) >= MIN_BYTES)
    pairs = tallied.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits)
    dense = members.where(F.col("_n") > most).select("fp").distinct()
    flips = F.array(F.lit(0).cast("long"), *[F.lit(_signed(1 << k)).cast("long") for k in range(BITS)])
    around = dense.select("fp", F.explode(F.transform(flips, lambda m: F.col("fp").bitwiseXOR(m))).alias("_v"))
    shared = around.groupBy("_v").agg(F.collect_list("fp").alias("_f")).where(F.size("_f") > 1)  # at most 65 can share one
    stars = shared.select(F.array_min("_f").alias("a"), F.explode("_f").alias("b")).where("a <> b")
    return pairs.unionByName(stars).distinct()


def classes(prints: DataFrame) -> DataFrame:
    """``fp, root, component_id`` for each distinct fingerprint of ``prints`` (``doc_id, fp``).

    Copies share a fingerprint and enter the index once. ``component_id`` is the
    smallest doc_id that is reachable; ``root`` names the class even where ids repeat.
    """
    fps = written(prints.groupBy("fp").agg(F.min("doc_id").alias("_least")), "fps")
    joined = connected(links(fps.select("fp")))
    rooted = fps.join(joined.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    rooted = written(rooted, "rooted")
    least = written(rooted.groupBy("root").agg(F.min("_least").alias("component_id")), "least")
    return rooted.join(least, "root").select("fp", "root", "component_id")


def _with_class(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Rows with the class of their fingerprint, by a join whose hot partitions can be split."""
    return rows.join(written(found, "classes"), "fp")


def near_duplicates(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS) -> DataFrame:
    """One row per input row: ``doc_id, fingerprint`` (16 hex digits), ``component_id``.

    Null, empty and blank texts have fingerprint zero and link like any other.
    Texts of any length are read whole. Repeated rows stay. A null id is never
    the smallest unless the class has no other. Other columns are not read,
    whatever they are called. An empty table gives an empty result.
    """
    prints = written(simhashes(documents, id_col, text_col, words), "prints")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return _with_class(prints, classes(prints)).select("doc_id", hexed.alias("fingerprint"), "component_id")


def drop_near_duplicates(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS, broadcast_ids: int = 1_000_000) -> DataFrame:
    """One document of each class, the one with the smallest id, with its columns as they came.

    Where ids are unique, the losers' ids are removed by an anti join; up to
    ``broadcast_ids`` of them (8 bytes each) are broadcast, beyond that the join
    is shuffled. Where ids are null or repeat, rows are told apart by a number
    within id and class.
    """
    prints = written(simhashes(documents, id_col, text_col, words), "prints")
    found = written(_with_class(prints, classes(prints)), "found")
    return keep_one_each(documents, found, id_col, text_col, lambda t: _signed(fingerprint(t, words)), broadcast_ids)


def keep_one_each(documents: DataFrame, found: DataFrame, id_col: str, text_col: str, mark, broadcast_ids: int) -> DataFrame:
    """The row kept of each class of ``found`` (``doc_id, fp, root, component_id``); ``mark`` gives a text's ``fp``."""
    plain = found.agg(F.count(F.lit(1)).alias("n"), F.count("doc_id").alias("ids")).first()
    if plain["n"] == plain["ids"] == found.select("doc_id").distinct().count():
        lost = written(found.where(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias("_lost")), "lost")
        lost = F.broadcast(lost) if lost.count() <= broadcast_ids else lost
        return unboxed(boxed(documents, _id=named(id_col).cast("long")).join(lost, F.col("_id") == F.col("_lost"), "left_anti"), documents.columns)
    return _one_each(documents, found, id_col, text_col, mark)


def _one_each(documents: DataFrame, found: DataFrame, id_col: str, text_col: str, mark) -> DataFrame:
    """The row kept of each class where ids do not tell rows apart."""
    marked = F.pandas_udf(lambda texts: texts.map(mark), "long")
    keys = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "fp")).alias("_k"))
    keys = keys.select(F.col("_k.doc_id").alias("_kid"), F.col("_k.fp").alias("_kfp"))
    held = boxed(documents, _id=named(id_col).cast("long"), _text=named(text_col).cast("string")).withColumn("_fp", marked("_text"))
    chosen = held.join(keys, F.col("_id").eqNullSafe(F.col("_kid")) & (F.col("_fp") == F.col("_kfp")), "left_semi")
    return unboxed(chosen.dropDuplicates(["_id", "_fp"]), documents.columns)
