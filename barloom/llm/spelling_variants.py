"""Spelling variant grouping: words one letter apart by a symmetric-delete join."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import named, written

LETTERS = "[A-Za-zÀ-ÿ]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MIN_LENGTH, MIN_COUNT, RATIO = 7, 2, 10
#: An odd number, the base of the keys' polynomials modulo 2^64.
BASE = 0x9E3779B97F4A7C15
#: So many characters, or one word, have their keys made at once.
SLICE = 1 << 18


def runs(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = MIN_LENGTH) -> DataFrame:
    """``id`` (as text), ``word``: each maximal run of letters of ``least`` or more, with A-Z in lower case; a null text has none."""
    found = F.regexp_extract_all(named(text_col).cast("string"), F.lit(f"{LETTERS}{{{least},}}+"), F.lit(0))
    rows = documents.select(F.coalesce(named(id_col).cast("string"), F.lit("")).alias("id"), F.explode(found).alias("word"))
    return rows.withColumn("word", F.translate("word", UPPER, LOWER))


def without(word: Column, at: Column) -> Column:
    """``word`` less its character at a place from 0."""
    return F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + F.lit(2), F.length(word)))


def misspelt(words: DataFrame) -> DataFrame:
    """The test damage of the query: where 31 divides crc32 of ``id:word``, one letter goes."""
    h = F.crc32(F.concat(F.col("id"), F.lit(":"), F.col("word")))
    at = (h % F.length("word")).cast("int")
    return words.withColumn("word", F.when(h % 31 == 0, without(F.col("word"), at)).otherwise(F.col("word")))


def counted(words: DataFrame, least_length: int = MIN_LENGTH, least_count: int = MIN_COUNT) -> DataFrame:
    """``word, n`` of the words long and common enough; occurrences are folded per task before the shuffle."""
    return words.where(F.length("word") >= least_length).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_count)


def _keys(words: list[str]) -> tuple[np.ndarray, ...]:
    """Keys of words and of their distinct single deletions: (word's place, key, own, first, last), arrays of one length.

    A key is the polynomial of the letters modulo 2^64, so the key of a deletion is
    the sum over what is before plus that over what is after, one place lower: all
    of a word take time in proportion to its length. ``first`` to ``last`` are the
    places that leave the same word, which a run of one letter has.
    """
    sizes = np.array([len(w) for w in words])
    codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    word = np.repeat(np.arange(len(words)), sizes)
    starts = np.cumsum(sizes) - sizes
    at = np.arange(len(codes)) - starts[word]
    with np.errstate(over="ignore"):
        power = np.cumprod(np.array([1] + [BASE] * int(sizes.max()), np.uint64))
        inverse = np.uint64(pow(BASE, -1, 1 << 64))
        mixed = (codes + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
        terms = (mixed ^ (mixed >> np.uint64(29))) * power[at]
        upto = np.cumsum(terms)
        total = upto[starts + sizes - 1] - upto[starts] + terms[starts]
        before = upto - terms - (upto - terms)[starts][word]
        after = total[word] - before - terms
        deleted = before + after * inverse + (sizes[word] - 1).astype(np.uint64)
        own = total + sizes.astype(np.uint64)
    leads = np.ones(len(codes), bool)
    leads[1:] = (codes[1:] != codes[:-1]) | (word[1:] != word[:-1])
    first = np.flatnonzero(leads)
    last = np.concatenate([first[1:], [len(codes)]]) - 1
    n, m = len(words), len(first)
    return (
        np.concatenate([np.arange(n), word[first]]), np.concatenate([own, deleted[first]]).view(np.int64),
        np.repeat([True, False], [n, m]), np.concatenate([np.full(n, -1), at[first]]), np.concatenate([np.full(n, -1), at[last]]),
    )


def _posted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words, ids = batch.column(1).to_pylist(), np.asarray(batch.column(0))
        start = 0
        while start < len(words):
            end, held = start, 0
            while end < len(words) and (end == start or held + len(words[end]) <= SLICE):
                held += len(words[end])
                end += 1
            at, key, own, first, last = _keys(words[start:end])
            columns = [pa.array(key), pa.array(ids[start:end][at]), pa.array(own), pa.array(first, pa.int32()), pa.array(last, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "id", "own", "first", "last"])
            start = end


def postings(words: DataFrame) -> DataFrame:
    """``key, id, own, first, last``: each of ``words`` (``id, word``) under itself and under its distinct single deletions."""
    return words.select("id", "word").mapInArrow(_posted, "key long, id long, own boolean, first int, last int")


def near_pairs(words: DataFrame) -> DataFrame:
    """``a, b, a_word, b_word, a_n, b_n`` of all pairs of ``words`` (``id, word, n``) exactly one edit apart, each pair once.

    Words that share a key meet: a word and another's deletion, or two deletions
    that leave the same at a place both can lose. That is one insertion, or one
    replacement, unless keys collide, which the words themselves then show. A key's
    posting holds at most one word for each letter and place, whatever the table.
    """
    index = postings(words)
    a, b = (index.select([F.col(c).alias(f"{s}_{c}") for c in index.columns]) for s in "ab")
    inserted = F.col("a_own") & ~F.col("b_own")
    replaced = ~F.col("a_own") & ~F.col("b_own") & (F.col("a_id") < F.col("b_id")) & (F.col("a_first") <= F.col("b_last")) & (F.col("b_first") <= F.col("a_last"))
    met = a.join(b, F.col("a_key") == F.col("b_key")).where(inserted | replaced)
    met = met.select(F.col("a_id").alias("a"), F.col("b_id").alias("b"), "a_own", F.greatest("a_first", "b_first").alias("at"))
    for side in "ab":
        met = met.join(words.select(F.col("id").alias(side), F.col("word").alias(f"{side}_word"), F.col("n").alias(f"{side}_n")), side)
    rest = without(F.col("b_word"), F.col("at"))
    same = F.when(F.col("a_own"), F.col("a_word") == rest).otherwise((without(F.col("a_word"), F.col("at")) == rest) & (F.col("a_word") != F.col("b_word")))
    return met.where(same).select("a", "b", "a_word", "b_word", "a_n", "b_n")


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` for ``word, form``: the end of each chain of forms.

    A round joins what has been reached with itself, so chains halve; each form is
    far more frequent than its word, so there is no circle and a few rounds do.
    """
    now = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = now.select(F.col("word").alias("_w"), F.col("root").alias("_r"))
        now = written(now.join(onward, F.col("root") == F.col("_w"), "left").select("word", F.coalesce("_r", "root").alias("root"), F.col("_r").isNotNull().alias("_moved")), "roots")
        if now.where("_moved").isEmpty():
            return now.select("word", "root")
        now = now.select("word", "root")


def variants(counts: DataFrame, ratio: int = RATIO) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for each row of ``counts`` (``word, n``, words distinct).

    Words are near if they differ by exactly one inserted, deleted or replaced
    character. A word's form is its most frequent near word, of equals the least,
    if that is ``ratio`` times as frequent at least, else null. The root is the end
    of the chain of forms, or the word itself. Words of any length are taken whole,
    in time and memory in proportion to it. No words give no rows.
    """
    words = written(counts.select("word", "n").withColumn("id", F.monotonically_increasing_id()), "words")
    pairs = near_pairs(words)
    sides = F.array(
        F.struct(F.col("a_word").alias("word"), F.col("a_n").alias("n"), F.col("b_word").alias("near"), F.col("b_n").alias("near_n")),
        F.struct(F.col("b_word").alias("word"), F.col("b_n").alias("n"), F.col("a_word").alias("near"), F.col("a_n").alias("near_n")),
    )
    both = pairs.select(F.explode(sides).alias("_s")).select("_s.*")
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("form"))).alias("_b"), F.max("n").alias("_n"))
    big = -F.col("_b.less") >= F.col("_n") * ratio
    best = written(best.select("word", "n_near", F.when(big, F.col("_b.form")).alias("form"), F.when(big, -F.col("_b.less")).alias("form_n")), "best")
    ends = roots(best.where("form IS NOT NULL").select("word", "form"))
    out = words.select("word", "n").join(best, "word", "left").join(ends, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")


def spelling_variants(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", damage: bool = False) -> DataFrame:
    """The words of whole texts with their forms and roots, as ``variants`` gives them.

    Null and empty texts have no word; repeated rows count again; a null id is an
    empty one (it only matters to ``damage``, the query's planted misspellings).
    Other columns are not read; an empty table gives an empty result.
    """
    words = runs(documents, id_col, text_col)
    return variants(counted(misspelt(words) if damage else words))

