"""Line dedup by log templates: a fixed-depth tree over token count and leading tokens."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import named, text_or_empty, trimmed, written

WILDCARD = b"<*>"
#: Leading tokens below the token count on a line's path through the tree.
DEPTH = 3
#: Bands that the tokens after the path fall into; one of them may vary.
BANDS = 4
#: A template that so many different texts hold recurs.
MIN_TEXTS = 3
#: A line that so many different texts hold word for word recurs, as does a long line by any of its templates.
EXACT_TEXTS = 2
#: Lines of so many tokens are long.
LONG_TOKENS = 50

_DIGIT = re.compile(rb"[0-9]")


def templates(line: bytes) -> list[bytes]:
    """The templates of a line of any length: paths through the tree and their leaves; a blank line has none.

    A token with a digit is a variable field. The path is the token count and
    the leading tokens; at the leaf the rest falls into four bands, and there is
    one template for each band that may vary. So two lines meet when they have
    equally many tokens, the same leading ones, and differ in one band at most.
    A line that has no more tokens than its path is its own template.
    """
    tokens = line.split()
    if not tokens:
        return []
    if _DIGIT.search(line):
        tokens = [WILDCARD if _DIGIT.search(t) else t for t in tokens]
    rest = tokens[DEPTH:]
    cuts = [len(rest) * k // BANDS for k in range(BANDS + 1)]
    filled = [k for k in range(BANDS) if cuts[k + 1] > cuts[k]]
    if not filled:
        return [b"%d %s" % (len(tokens), b" ".join(tokens))]
    bands = [b" ".join(rest[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
    path = b"%d %s " % (len(tokens), b" ".join(tokens[:DEPTH]))
    return [path + b" ".join([*bands[:k], WILDCARD, *bands[k + 1 :]]) for k in filled]


def exact_templates(line: bytes) -> tuple[list[bytes], list[bytes]]:
    """The templates that two texts suffice for (the line word for word; any of a long line's), and the others."""
    found, tokens = templates(line), line.split()
    if not found or len(tokens) >= LONG_TOKENS:
        return found, []
    whole = b"%d %s" % (len(tokens), b" ".join(tokens))
    return [whole], [] if found == [whole] else found


def _line_keys(text: str, exact: bool) -> Iterator[tuple[int, int]]:
    """(line number, key) of a text's templates; with ``exact`` the keys of those that two texts suffice for are odd and the others even."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    for n, line in enumerate(text.encode("utf-8", "surrogatepass").split(b"\n")):
        if exact:
            few, many = exact_templates(line)
            for t in few:
                yield n, (digest(t) | 1) - (1 << 63)
            for t in many:
                yield n, (digest(t) >> 1 << 1) - (1 << 63)
        else:
            for t in templates(line):
                yield n, digest(t) - (1 << 63)


def _keys(exact: bool):
    """Rows of template keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):
                part = batch.slice(start, SLICE)
                docs, marks, lines, keys = [], [], [], []
                for doc_id, mark, text in zip(*(part.column(k).to_pylist() for k in range(3)), strict=True):
                    for n, key in _line_keys(text, exact):
                        docs.append(doc_id)
                        marks.append(mark)
                        lines.append(n)
                        keys.append(key)
                columns = [pa.array(docs, pa.int64()), pa.array(marks, pa.int64()), pa.array(lines, pa.int32()), pa.array(keys, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["_id", "_mark", "_line", "_key"])

    return trimmed(run)


#: Rows of which the line keys are held at once.
SLICE = 512


def _gone(found, exact: bool):
    """Appends the numbers of the lines that go to rows of ``_id, _text``; ``found`` has the recurring templates in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, firsts, without = found.value
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):
                part = batch.slice(start, SLICE)
                ids, texts = (part.column(part.schema.names.index(c)).to_pylist() for c in ("_id", "_text"))
                rows, lines, keys = [], [], []
                for k, text in enumerate(texts):
                    for n, key in _line_keys(text, exact):
                        rows.append(k)
                        lines.append(n)
                        keys.append(key)
                lost: list[set[int]] = [set() for _ in ids]
                if len(known) and keys:
                    wanted = np.array(keys, dtype=np.int64)
                    at = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
                    for j in np.flatnonzero(known[at] == wanted).tolist():
                        first = None if without[at[j]] else int(firsts[at[j]])
                        if ids[rows[j]] != first:
                            lost[rows[j]].add(lines[j])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([sorted(x) for x in lost], pa.list_(pa.int32()))], names=[*part.schema.names, "_dropped"])

    return trimmed(run)


def _held(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows of ``_row`` (all columns but the text), ``_id``, ``_text``, ``_null`` (was there no text) and ``_mark``."""
    text = text_or_empty(text_col)
    rest = [named(c) for c in documents.columns if c != text_col] or [F.lit(0).alias("_none")]
    return documents.select(F.struct(*rest).alias("_row"), named(id_col).cast("long").alias("_id"), text.alias("_text"), named(text_col).isNull().alias("_null"), F.xxhash64(text).alias("_mark"))


def recurring(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_texts: int = MIN_TEXTS, exact_texts: int | None = None) -> DataFrame:
    """``_key, _first, _texts``: templates in at least ``min_texts`` different texts, and the smallest id.

    With ``exact_texts``, so many suffice for lines that are equal word for word
    and for the templates of long lines.

    Whole copies of a document count once: they are duplicates of documents and
    not of lines. Counts are folded per task and per text before they meet, so
    a line in a third of all documents costs one row per task.
    """
    rows = _held(documents, id_col, text_col).select("_id", "_mark", "_text").mapInArrow(_keys(exact_texts is not None), "_id long, _mark long, _line int, _key long")
    by_text = rows.groupBy("_key", "_mark").agg(F.min("_id").alias("_first"))
    enough = F.lit(min_texts) if exact_texts is None else F.when(F.col("_key").bitwiseAND(F.lit(1).cast("long")) == 1, exact_texts).otherwise(min_texts)
    return by_text.groupBy("_key").agg(F.min("_first").alias("_first"), F.count(F.lit(1)).alias("_texts")).where(F.col("_texts") >= enough)


def drop_lines(
    documents: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_texts: int = MIN_TEXTS,
    report: bool = False,
    broadcast_templates: int = 1_000_000,
    exact_texts: int | None = None,
) -> DataFrame:
    """``documents`` without the lines of recurring templates, except in each template's first document.

    Templates recur as in ``recurring``. The first is the one with the smallest id, so some copy of every passage
    stays. Documents keep all columns; ``text_col`` has its other lines in order.
    A document that loses all its words goes, unless ``report`` is set; then all
    rows stay, with ``_lines`` (how many there were) and ``_dropped`` (the numbers of those that went). A null
    text counts as empty and comes back as it was; a null id is never first.
    Rows repeated in id and text are treated alike. Blank lines always stay.
    Texts of any length are read whole. An empty table gives an empty result.

    Up to ``broadcast_templates`` recurring templates (17 bytes each) are
    broadcast to the second scan, which drops lines where it reads them, so no
    text is shuffled. Beyond that templates meet lines by a join, and the numbers
    of the lines that go meet their documents by another.
    """
    columns = documents.columns
    exact = exact_texts is not None
    held = _held(documents, id_col, text_col)
    found = written(recurring(documents, id_col, text_col, min_texts, exact_texts), "templates").select("_key", "_first")
    if found.count() <= broadcast_templates:
        table = found.orderBy("_key").toArrow()
        firsts = table["_first"].combine_chunks() if table.num_rows else pa.array([], pa.int64())
        shared = documents.sparkSession.sparkContext.broadcast((table["_key"].to_numpy(), firsts.fill_null(0).to_numpy(), firsts.is_null().to_numpy(zero_copy_only=False)))
        wide = held.drop("_mark")
        done = wide.mapInArrow(_gone(shared, exact), T.StructType([*wide.schema.fields, T.StructField("_dropped", T.ArrayType(T.IntegerType()))]))
    else:
        rows = held.select("_id", "_mark", "_text").mapInArrow(_keys(exact), "_id long, _mark long, _line int, _key long")
        gone = rows.join(found, "_key").where(~F.col("_id").eqNullSafe(F.col("_first"))).groupBy("_id", "_mark").agg(F.array_sort(F.collect_set("_line")).alias("_dropped"))
        gone = gone.select(F.col("_id").alias("_gid"), F.col("_mark").alias("_gmark"), "_dropped")
        same = F.col("_id").eqNullSafe(F.col("_gid")) & (F.col("_mark") == F.col("_gmark"))
        done = held.join(gone, same, "left").withColumn("_dropped", F.coalesce("_dropped", F.array().cast("array<int>")))
    untouched = F.size("_dropped") == 0
    lines = F.split("_text", "\n")
    left = F.array_join(F.filter(lines, lambda s, i: ~F.array_contains(F.col("_dropped"), i)), "\n")
    done = done.withColumn("_new", F.when(untouched, F.when(~F.col("_null"), F.col("_text"))).otherwise(left))
    out = [(F.col("_new") if c == text_col else F.col("_row").getField(c)).alias(c) for c in columns]
    if report:
        return done.select(*out, F.size(lines).alias("_lines"), "_dropped")
    return done.where(untouched | F.col("_new").rlike(r"[^\x20\x09-\x0D]")).select(*out)


def line_report(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", exact_texts: int | None = None) -> DataFrame:
    """One row per input row: id, lines, lines dropped and where, and a digest of what stays.

    Nulls, empty and long texts, repeated rows and empty tables are as in ``drop_lines``; other columns are not read.
    """
    held = drop_lines(documents.select(named(id_col).alias("doc_id"), named(text_col).alias("text")), "doc_id", "text", report=True, exact_texts=exact_texts)
    return held.select(
        "doc_id",
        F.col("_lines").cast("long").alias("n_lines"),
        F.size("_dropped").cast("long").alias("n_dropped"),
        F.array_join("_dropped", ",").alias("dropped_lines"),
        F.sha2(text_or_empty("text"), 256).alias("kept_sha256"),
    )
