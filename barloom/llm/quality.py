"""Quality rules: a threshold table compiled into one projection (native)."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, boxed, named, text_or_empty, unboxed, words_of

WINDOW = 8
SYMBOLS = "[#*$%&|<>]"

# Very common function words of the four languages of the corpus.
STOP_WORDS = (
    "the", "and", "of", "to", "in", "is", "it", "that", "with", "for", "on", "as", "was", "are", "by", "be", "this", "or", "an", "at",
    "le", "la", "les", "de", "des", "du", "et", "un", "une", "en", "que", "qui", "dans", "pour", "par", "sur", "est", "au",
    "der", "die", "das", "und", "den", "von", "zu", "mit", "ist", "dem", "ein", "eine", "auf", "für", "im", "nicht", "sich", "des",
    "el", "los", "las", "y", "del", "se", "por", "con", "una", "para", "es", "lo", "su", "al", "no",
)


@dataclass(frozen=True)
class Rule:
    """``metric`` must lie in [low, high]; it is a SQL expression over METRICS."""

    name: str
    metric: str
    low: float | None = None
    high: float | None = None


#: The threshold table. Ratios are written as products, so none divides by zero.
BASE_RULES = (
    Rule("enough_words", "n_words", low=20),
    Rule("few_repeats", "100 * n_repeat_words - 30 * n_words", high=0),
)
RULES = (
    *BASE_RULES,
    Rule("mean_word_low", "word_chars - 2 * n_words", low=0),
    Rule("mean_word_high", "word_chars - 20 * n_words", high=0),
    Rule("few_symbols", "10 * n_symbols - n_words", high=0),
    Rule("few_dup_lines", "10 * n_dup_lines - 6 * n_lines", high=0),
    Rule("some_stop_words", "100 * n_stop_words - 3 * n_words", low=0),
)


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once however often ``body`` names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeat_words(words: Column) -> Column:
    """How many words stand in a window of eight that the text holds twice or more.

    Windows are 64-bit hashes built by doubling (1, 2, 4, 8 words), one pass
    each. Nearly all texts stop at "no window repeats", a hash-set count. In the
    others the hashes are sorted with their places; a hash beside an equal one
    is a repeat, and the union of the windows is summed over its sorted starts.
    """

    def paired(a: Column, step: int) -> Column:
        return F.transform(a, lambda x, i: F.xxhash64(x, F.get(a, i + step)))

    def full(h: Column) -> Column:
        return F.slice(h, F.lit(1), F.greatest(F.size(h) - (WINDOW - 1), F.lit(0)))

    def starts(s: Column) -> Column:
        beside = F.filter(s, lambda x, k: (x["h"] == F.get(s, k - 1)["h"]) | (x["h"] == F.get(s, k + 1)["h"]))
        return F.array_sort(F.transform(beside, lambda x: x["i"]))

    def covered(hashes: Column) -> Column:
        zero = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n"))
        step = lambda acc, i: F.struct(i.alias("last"), (acc["n"] + F.least(F.lit(WINDOW), i - acc["last"])).alias("n"))
        placed = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return _let(placed, lambda s: F.aggregate(starts(s), zero, step, lambda acc: acc["n"]))

    def judged(h: Column) -> Column:
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h))

    ones = F.transform(words, lambda w: F.xxhash64(w))
    return _let(ones, lambda a: _let(paired(a, 1), lambda b: _let(paired(b, 2), lambda c: _let(full(paired(c, 4)), judged))))


def with_metrics(df: DataFrame, text_col: str = "text", stop_words: Sequence[str] = STOP_WORDS) -> DataFrame:
    """``df`` with the measures that rules are written over, as the struct ``_m``.

    Null and empty texts have zero of everything. Other columns stay as they
    are, but for one that is called ``_m``.
    """
    taken = {c.lower() for c in df.columns}
    t, w, lines, j = (next(n for n in (f"{'_' * k}{name}" for k in range(1, len(taken) + 2)) if n not in taken) for name in "twlj")
    held = df.withColumn(t, text_or_empty(text_col)).withColumn(w, words_of(F.col(t)))
    held = held.withColumn(lines, F.filter(F.split(t, "\n"), lambda s: s.rlike(WORD))).withColumn(j, F.array_join(w, ""))
    measures = F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.length(j).cast("long").alias("word_chars"),
        (F.length(j) - F.length(F.regexp_replace(j, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.size(lines).cast("long").alias("n_lines"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col(w)).cast("long").alias("n_repeat_words"),
        F.size(F.filter(w, lambda x: F.lower(x).isin(*dict.fromkeys(stop_words)))).cast("long").alias("n_stop_words"),
    )
    return held.withColumn("_m", measures).drop(t, w, lines, j)


def verdict(rules: Sequence[Rule], of: str = "_m") -> Column:
    """True where every rule holds: the table as one conjunction over ``of``."""
    good = F.lit(True)
    for rule in rules:
        measured = _measure(rule.metric, of)
        if rule.low is not None:
            good = good & (measured >= F.lit(rule.low))
        if rule.high is not None:
            good = good & (measured <= F.lit(rule.high))
    return good


METRICS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_stop_words")


def _measure(metric: str, of: str) -> Column:
    """A rule's expression with its names read from the struct of measures."""
    return F.expr(re.sub(r"\b(" + "|".join(METRICS) + r")\b", rf"{of}.\1", metric))


def judge(df: DataFrame, text_col: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """``df`` with ``_m`` (all measures), ``_base_failed`` and ``_kept``.

    One narrow projection: no shuffle and no function outside the JVM. A null
    text counts as empty; as it has under 20 words, it is rejected. ``rules``
    add to the base rules and never replace them.
    """
    held = with_metrics(df, text_col)
    return held.withColumn("_base_failed", ~verdict(BASE_RULES)).withColumn("_kept", ~F.col("_base_failed") & verdict(rules))


def quality_report(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """One row per input row: its id, its measures and both verdicts.

    Null and empty texts have no word and fail; texts of any length are read
    whole; null ids and repeated rows stay; other columns are not read; an empty
    table gives an empty result.
    """
    held = judge(documents.select(named(id_col).alias("doc_id"), named(text_col).alias("_text")), "_text", rules)
    return held.select(
        "doc_id", "_m.n_words", "_m.word_chars", "_m.n_symbols", "_m.n_dup_lines", "_m.n_repeat_words",
        F.col("_base_failed").alias("base_failed"), F.col("_kept").alias("kept"), "_m.n_stop_words", "_m.n_lines",
    )


def keep_good(documents: DataFrame, text_col: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """The rows that pass, with the columns they came with."""
    held = judge(boxed(documents, _text=named(text_col)), "_text", rules).where("_kept")
    return unboxed(held, documents.columns)
