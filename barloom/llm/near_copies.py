"""Near copies by the Jaccard similarity of their shingles: SimHash index, prefix index for the rest, exact verification, components."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import named, trimmed, written
from .components import connected
from .simhash import _signed, keep_one_each, majority
from .simhash import links as alike

SHINGLE_WORDS, SIMILARITY = 5, 0.8
#: One document in so many, or so many documents if that is more, tell which shingles are common: so many at most. It only
#: orders shingles; links do not depend on it.
SAMPLE_SHARE, SAMPLE_DOCS, MOST_COMMON = 8, 4_000, 1_000_000
#: Long numbers in the parity bits of a set.
WORDS = 8
#: Rows of which the shingles are held at once.
SLICE = 256


def shingles(text: str | None, words: int = SHINGLE_WORDS) -> np.ndarray:
    """The distinct shingle hashes of a text, ascending; a shorter text is one shingle, a blank one has none."""
    import xxhash

    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.empty(0, np.int64)
    n = max(1, len(found) - words + 1)
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(b" ".join(found[k : k + words]), 42) for k in range(n)), np.uint64, n)).view(np.int64)


def mark(found: np.ndarray) -> int:
    """One number for a set of shingles."""
    import xxhash

    return xxhash.xxh64_intdigest(found.tobytes(), 7) - (1 << 63)


def parity(found: np.ndarray) -> np.ndarray:
    """Bits that each shingle flips one of: two sets differ in as many shingles as bits at least."""
    odd = np.bincount(found & (64 * WORDS - 1), minlength=64 * WORDS) & 1
    return np.packbits(odd.astype(bool)).view(np.int64)


def _prefix(found: np.ndarray, similarity: float) -> np.ndarray:
    """So many of the shingles that any two similar sets share one of them, if both are in the same order."""
    return found[: len(found) - math.ceil(len(found) * similarity - 1e-6) + 1] if len(found) else found


def _lists(held: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, held)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(held) if held else [], pa.int64()))


def _marks(words: int, similarity: float, common: np.ndarray, counts: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):
                part = batch.slice(start, SLICE)
                fps, sizes, sims, bits, held = [], [], [], [], []
                for text in part.column(2).to_pylist():
                    found = shingles(text, words)
                    fps.append(mark(found))
                    sizes.append(len(found))
                    sims.append(_signed(majority(found)))
                    bits.append(parity(found))
                    if len(common):
                        at = np.minimum(np.searchsorted(common, found), len(common) - 1)
                        found = found[np.argsort(np.where(common[at] == found, counts[at], 0), kind="stable")]
                    held.append(_prefix(found, similarity))
                columns = [part.column(0), part.column(1), pa.array(fps, pa.int64()), pa.array(sizes, pa.int32())]
                columns += [pa.array(sims, pa.int64()), _lists(bits), _lists(held)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "_t", "fp", "_n", "sim", "bits", "first"])

    return trimmed(run)


def _each(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):
                held = [shingles(t, words) for t in batch.slice(start, SLICE).column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(held))], names=["s"])

    return trimmed(run)


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):
                held = [shingles(t, words) for t in batch.slice(start, SLICE).column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(list(map(mark, held)), pa.int64()), _lists(held)], names=["_u", "set"])

    return trimmed(run)


def _held(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = named(text_col).cast("string")
    return documents.select(named(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("_t"), text.alias("_text"))


def _common(held: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The commonest shingles of a sample, ascending, and how often each was seen."""
    share = max(1 / SAMPLE_SHARE, min(1.0, SAMPLE_DOCS / max(1, held.count())))
    sample = held.where(F.pmod(F.xxhash64("_t", "doc_id"), F.lit(1 << 20)) < int(share * (1 << 20))).select("_text")
    seen = written(sample.mapInArrow(_each(words), "s long").groupBy("s").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "seen")
    least, total = 1 << 62, 0
    for n, c in sorted(((r["n"], r["c"]) for r in seen.groupBy("n").agg(F.count(F.lit(1)).alias("c")).collect()), reverse=True):
        total += c
        if total > MOST_COMMON:
            break
        least = n
    rows = seen.where(F.col("n") >= least).toArrow()
    found, counts = rows["s"].to_numpy(), rows["n"].to_numpy().astype(np.int32)
    order = np.argsort(found)
    return found[order], counts[order]


def prefixes(held: DataFrame, words: int, similarity: float) -> DataFrame:
    """``doc_id, _t, fp, _n, sim, bits, first``: a number for the set of each row, its size, SimHash, parity bits and its prefix in an order, rare ones first, that all rows share."""
    kind = "doc_id long, _t long, fp long, _n int, sim long, bits array<long>, first array<long>"
    return held.mapInArrow(_marks(words, similarity, *_common(held, words)), kind)


def _needed(a: Column, b: Column, similarity: float) -> Column:
    """The least overlap of two sets of these sizes at ``similarity``, less a rounding error."""
    return (a + b) * (similarity / (1 + similarity)) - 1e-6


def _met(left: DataFrame, right: DataFrame, similarity: float, more: Column) -> DataFrame:
    """Members of one posting whose sizes allow a link: ``a, b``, and ``_first`` where nothing that they share has to stand before."""
    a, b = (x.select("_k", *[F.col(c).alias(s + c) for c in ("_u", "_n", "_at", "_p", "_d", "root", "_most") if c in x.columns]) for x, s in ((left, "a"), (right, "b")))
    needed = _needed(F.col("a_n"), F.col("b_n"), similarity)
    sized = F.least("a_n", "b_n") >= F.greatest("a_n", "b_n") * similarity - 1e-6
    found = a.join(b, "_k").where((F.col("a_u") != F.col("b_u")) & (F.col("aroot") != F.col("broot")) & sized & more)
    after = F.greatest(F.col("a_n") - F.col("a_p"), F.col("b_n") - F.col("b_p"))
    return found.select(
        F.least("a_u", "b_u").alias("a"),
        F.greatest("a_u", "b_u").alias("b"),
        (F.least(F.col("a_n") - F.col("a_at"), F.col("b_n") - F.col("b_at")) >= needed).alias("_first"),
        (needed - after - F.least("a_d", "b_d")).alias("_least"),
    )


def _tallied(light: DataFrame, stars: DataFrame) -> DataFrame:
    """Pairs that may be similar by the tally of what their prefixes share.

    Of two sets, those shingles that are not in both prefixes come after the end
    of one of them, so the shared postings bound the overlap. Dense postings are
    not tallied; ``_least`` allows for all that a set has of them.
    """
    met = light.withColumn("_c", F.lit(1)).unionByName(stars.withColumn("_c", F.lit(0)))
    found = met.groupBy("a", "b").agg(F.sum("_c").alias("_c"), F.max("_first").alias("_first"), F.max("_least").alias("_least"))
    return found.where("_first AND _c >= _least").select("a", "b")


def _verified(pairs: DataFrame, firsts: DataFrame, sets_of: Callable[[DataFrame], DataFrame], similarity: float) -> DataFrame:
    """The pairs whose whole sets are similar; only those whose parity bits, where ``firsts`` has them, allow it are compared."""
    if "bits" in firsts.columns:
        a, b = (firsts.select(F.col("_u").alias(s), F.col("_n").alias(f"{s}n"), F.col("bits").alias(f"{s}s")) for s in "ab")
        differ = sum((F.bit_count(F.get("as", F.lit(k)).bitwiseXOR(F.get("bs", F.lit(k)))) for k in range(WORDS)), F.lit(0))
        both = (F.col("an") + F.col("bn") - differ) / 2
        pairs = written(pairs.join(b, "b").join(a, "a").where(both >= _needed(F.col("an"), F.col("bn"), similarity)).select("a", "b"), "near")
    sets = written(sets_of(pairs.select(F.explode(F.array("a", "b")).alias("_u")).distinct()), "sets")
    a, b = (sets.select(F.col("_u").alias(s), F.col("set").alias(f"{s}s")) for s in "ab")
    same = F.size(F.array_intersect("as", "bs"))
    similar = same >= _needed(F.size("as"), F.size("bs"), similarity)
    return written(pairs.join(b, "b").join(a, "a").where(similar).select("a", "b"), "links")


def fingerprint_pairs(firsts: DataFrame) -> DataFrame:
    """Pairs ``a, b`` of sets by their SimHash ``sim``: the index of positional bytes links the fingerprints, each standing for its least set."""
    least = written(firsts.groupBy("sim").agg(F.min("_u").alias("a")), "sims")
    found = alike(least.select(F.col("sim").alias("fp")))
    for side in "ab":
        found = found.join(least.select(F.col("sim").alias(side), F.col("a").alias(f"_{side}")), side)
    same = firsts.select("sim", F.col("_u").alias("b")).join(least, "sim").where("a <> b").select("a", "b")
    return same.unionByName(found.select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")))


def links(firsts: DataFrame, sets_of: Callable[[DataFrame], DataFrame], similarity: float = SIMILARITY, most: int = 64) -> DataFrame:
    """Pairs ``a, b`` that join all similar sets of ``firsts`` (``_u, _n, first``: number, size and prefix, once each).

    Where ``firsts`` has fingerprints ``sim``, those that differ in few bits are
    found first by SimHash's index and verified; what is linked so is not paired
    again. Bits tell nothing for certain about sets that are similar, so the
    rest is found by an index that loses nothing: of two sets with Jaccard
    similarity t, the first n - ceil(t n) + 1 shingles of each in a common order
    share one, so postings of these lose no pair. Pairs are verified by all their
    shingles: ``sets_of`` gives ``_u, set`` of the numbers ``_u``. A posting with
    over ``most`` members first links them to its least and greatest one; then
    only those outside its largest class are paired with the members of other
    classes, and only those that ``_bounded`` leaves: a large group of near copies,
    or of pages of one template, costs rows in proportion and no component is lost.
    """
    found = _verified(fingerprint_pairs(firsts), firsts, sets_of, similarity) if "sim" in firsts.columns else None
    index = firsts.select("_u", "_n", F.size("first").alias("_p"), F.posexplode("first").alias("_at", "_k"))
    sizes = written(index.select("_k").groupBy("_k").agg(F.count(F.lit(1)).alias("_m")).where("_m > 1"), "postings")
    members = written(index.join(sizes.hint("shuffle_hash"), "_k"), "members")
    hot = members.where(F.col("_m") > most).groupBy("_u").agg(F.count(F.lit(1)).alias("_d"))
    members = members.join(hot, "_u", "left").withColumn("_d", F.coalesce("_d", F.lit(0)))
    members = written(_rooted(members, found), "rooted_members")
    light, dense = members.where(F.col("_m") <= most), members.where(F.col("_m") > most)
    ends = dense.groupBy("_k").agg(F.min("_u").alias("_low"), F.max("_u").alias("_high"))
    stars = _met(dense.join(ends, "_k").where("_u = _low OR _u = _high"), dense, similarity, F.col("a_u").isNotNull())
    pairs = written(_tallied(_met(light, light, similarity, F.col("a_u") < F.col("b_u")), stars), "pairs")
    rest = _verified(pairs, firsts, sets_of, similarity)
    found = rest if found is None else found.unionByName(rest)
    if dense.isEmpty():
        return found
    dense = written(_bounded(_rooted(dense, found), similarity), "dense")
    main = dense.groupBy("_k", "root").agg(F.count(F.lit(1)).alias("_c")).groupBy("_k").agg(F.max_by("root", F.struct("_c", "root")).alias("_main"))
    placed = dense.join(main, "_k").withColumn("_out", F.col("root") != F.col("_main"))
    outside, able = placed.where("_out"), placed.where("_most >= _n")
    sized = (F.col("a_n") <= F.col("b_most")) & (F.col("b_n") <= F.col("a_most"))
    # the smaller of a pair must be able to reach the larger one's size; pairs within the largest class are not wanted
    more = _met(able.where("_out"), dense, similarity, sized & (F.col("a_n") <= F.col("b_n"))).unionByName(_met(outside, able.where("NOT _out"), similarity, sized & (F.col("b_n") <= F.col("a_n"))))
    more = written(more.where("_first").select("a", "b").distinct(), "pairs")
    return found.unionByName(_verified(more, firsts, sets_of, similarity))


def _bounded(dense: DataFrame, similarity: float) -> DataFrame:
    """``dense`` with ``_most``, the size of the largest set to which a member may be similar if they share no posting but dense ones.

    What stands in a prefix before the posting and is in no dense one is then in one
    of the two sets alone: were it in both, it would be in both prefixes. So the
    overlap is the size less these at most, and bounds the other's size. Of pages
    that fill in a template with words of their own no two are large enough.
    """
    alone = F.col("_at") - (F.row_number().over(Window.partitionBy("_u").orderBy("_at")) - 1)
    return dense.withColumn("_most", (F.col("_n") - alone) * ((1 + similarity) / similarity) - F.col("_n") + 1e-6)


def _rooted(members: DataFrame, found: DataFrame | None) -> DataFrame:
    """``members`` with the ``root`` of their class under the links ``found``."""
    if found is None:
        return members.withColumn("root", F.col("_u"))
    roots = connected(found).withColumnRenamed("node", "_u")
    return members.drop("root").join(roots, "_u", "left").withColumn("root", F.coalesce("root", "_u"))


def drop_near_copies(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS, similarity: float = SIMILARITY, broadcast_ids: int = 1_000_000) -> DataFrame:
    """One document of each class of near copies, the one with the smallest id, with its columns as they came.

    Two texts are near copies where the Jaccard similarity of their shingles of
    ``words`` words is ``similarity`` at least; classes are the components of
    these links. Texts without a word, null ones among them, are one class. Null
    and repeated ids are allowed: of rows with equal id and text one stays. Texts of
    any length are read whole; other columns stay, whatever they are called. An
    empty table gives an empty result.
    """
    held = _held(documents, id_col, text_col)
    sets = written(prefixes(held, words, similarity).withColumn("_row", F.monotonically_increasing_id()), "prefixes")
    nodes = written(sets.groupBy("fp").agg(F.min("_row").alias("_first"), F.min("doc_id").alias("_least")), "nodes")
    copies = written(sets.select("fp", "_row").join(nodes.select("fp", "_first"), "fp").where("_row <> _first").select("_row"), "copies")
    copies = F.broadcast(copies) if copies.count() <= broadcast_ids else copies
    single = sets.join(copies, "_row", "left_anti")

    def sets_of(wanted: DataFrame) -> DataFrame:
        texts = written(single.select(F.col("fp").alias("_u"), "_t").join(wanted, "_u").select("_t").distinct(), "texts")
        texts = F.broadcast(texts) if texts.count() <= broadcast_ids else texts
        found = held.join(texts, "_t", "left_semi").select("_text").mapInArrow(_sets(words), "_u long, set array<long>")
        return found.join(wanted, "_u", "left_semi").dropDuplicates(["_u"])

    roots = connected(links(single.select(F.col("fp").alias("_u"), "_n", "sim", "bits", "first"), sets_of, similarity)).withColumnRenamed("node", "fp")
    rooted = written(nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "rooted")
    least = written(rooted.groupBy("root").agg(F.min("_least").alias("component_id")), "least")
    classes = written(rooted.join(least, "root").select("fp", "root", "component_id"), "classes")
    found = written(sets.select("doc_id", "fp").join(classes, "fp"), "found")
    return keep_one_each(documents, found, id_col, text_col, lambda t: mark(shingles(t, words)), broadcast_ids)
