"""Language-model scores by context-tree weighting over binary-decomposed bytes.

A byte is eight binary decisions, numbered 1 to 255 by the bits before them. Each
decision has a tree of contexts: nothing, the last byte, the last two, and so on
to ``DEPTH`` bytes. A node's estimate is Krichevsky-Trofimov's,
(n1 + 1/2) / (n0 + n1 + 1), and its weight halves between stopping there and its
deeper contexts, by how well either would have coded the training bytes. A text
ends with byte 0, and zero bytes stand before it.

The tree is never gathered: every context of the training texts has its node,
and the nodes grow with the corpus. A text's score is the sum over its grams (the
context's bytes and the byte after them) of one number each, so the tree is a
table of grams: counted by a shuffle, solved by subtrees of ``TOP`` context bytes
in tasks, and met by the texts again. Only the nodes above the subtrees, 65,536
at most, are solved on the driver. Grams of texts that are not learnt from are in
the table with count nought, so each place of each text meets a row.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import named, text_or_empty, written

#: Context bytes. A gram has one byte more and is one number: the newest context byte highest, the byte itself lowest.
DEPTH = 5
#: Context bytes that name a subtree. A task solves whole subtrees, about GRAMS_A_TASK rows of them.
TOP = 2
GRAMS_A_TASK = 400_000
HALF = np.log(0.5)
_PAD = b"\0" * DEPTH


def log_gamma(x: np.ndarray) -> np.ndarray:
    """ln Gamma for positive x: Stirling's series after a shift by eight."""
    z = x + 8.0
    series = (z - 0.5) * np.log(z) - z + 0.5 * np.log(2 * np.pi) + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - 1 / (1680 * z**7)
    shift = np.ones_like(z)
    for k in range(8):
        shift = shift * (x + k)
    return series - np.log(shift)


def kt_log(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """ln of the Krichevsky-Trofimov probability of a sequence with n0 zeros and n1 ones."""
    return log_gamma(n0 + 0.5) + log_gamma(n1 + 0.5) - np.log(np.pi) - log_gamma(n0 + n1 + 1.0)


def estimate(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    return (n1 + 0.5) / (n0 + n1 + 1.0)


def weigh(own: np.ndarray, children: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ln weighted probability, chance of stopping) of nodes, given their own ln evidence and the sum over their children."""
    own = HALF + own
    total = np.logaddexp(own, HALF + children)
    return total, np.exp(own - total)


def buffer_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes with pads, each text's first place, its length). A text's end is the pad byte after it."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    data = np.frombuffer(_PAD + _PAD.join(texts) + _PAD, dtype=np.uint8)
    starts = DEPTH + np.concatenate([[0], np.cumsum(sizes + DEPTH)[:-1]]).astype(np.int64)
    return data, starts, sizes


def batched(texts: Iterator[bytes], most: int = 1 << 20) -> Iterator[list[bytes]]:
    held, size = [], 0
    for t in texts:
        held.append(t)
        size += len(t) + DEPTH
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def grams_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(each place's gram, each text's number of places): the places are those of its bytes and its end."""
    data, starts, sizes = buffer_of(texts)
    n = len(data) - DEPTH
    code = np.zeros(n, dtype=np.int64)
    for back in range(1, DEPTH + 1):
        code |= data[DEPTH - back : DEPTH - back + n]
        code <<= 8
    code |= data[DEPTH:]
    keep = np.ones(n, dtype=bool)
    for k in range(1, DEPTH):  # the rest of the pad after each text's end byte
        at = starts + sizes - DEPTH + k
        keep[at[at < n]] = False
    return code[keep], sizes + 1


def _lowered(values: list[str | None]) -> Iterator[bytes]:
    return ((v or "").encode("utf-8", "surrogatepass").lower() for v in values)


def _folded(codes: np.ndarray, *counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct numbers in order, and the sums of their counts."""
    order = np.argsort(codes, kind="stable")
    codes = codes[order]
    first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]])) if len(codes) else np.zeros(0, np.int64)
    return codes[first], *(np.add.reduceat(c[order], first) if len(first) else c for c in counts)


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of gram, places, and places in training texts."""
    held: list[tuple[np.ndarray, ...]] = []
    for batch in batches:
        learnt = batch.column(0).to_numpy(zero_copy_only=False).astype(bool)
        texts = list(_lowered(batch.column(1).to_pylist()))
        for use in (True, False):
            for part in batched(t for t, x in zip(texts, learnt.tolist(), strict=True) if x == use):
                codes, n = np.unique(grams_of(part)[0], return_counts=True)
                held.append((codes, n, n if use else np.zeros_like(n)))
                if len(held) >= 8:
                    held[:] = [_folded(*map(np.concatenate, zip(*held, strict=True)))]
                    if len(held[0][0]) > 2_000_000:
                        yield _gram_rows(held.pop())
    if held:
        yield _gram_rows(_folded(*map(np.concatenate, zip(*held, strict=True))))


def _gram_rows(found: tuple[np.ndarray, ...]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in found], names=["g", "n", "learnt"])


def gram_counts(rows: DataFrame) -> DataFrame:
    """``g, n, learnt`` of all grams of ``rows`` (``learn, t``): places, and those to learn from; folded per task before the shuffle."""
    found = rows.select("learn", "t").mapInArrow(_count_grams, "g long, n long, learnt long")
    return found.groupBy("g").agg(F.sum("n").alias("n"), F.sum("learnt").alias("learnt"))


class _Level:
    """The grams of contexts of one depth, in order, and which deeper gram belongs to which."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray, up: np.ndarray | None):
        self.codes, self.counts, self.up = codes, counts, up


def levels(grams: np.ndarray, learnt: np.ndarray) -> list[_Level]:
    """From full depth up to ``TOP``: a depth's grams lack the oldest byte of those one deeper."""
    out = [_Level(grams, learnt.astype(np.float64), None)]
    for _ in range(DEPTH - TOP):
        deeper = out[-1]
        codes, deeper.up = np.unique(deeper.codes >> 16 << 8 | deeper.codes & 255, return_inverse=True)
        out.append(_Level(codes, np.bincount(deeper.up, weights=deeper.counts, minlength=len(codes)), None))
    return out


def solve(grams: np.ndarray, learnt: np.ndarray) -> tuple[np.ndarray, tuple[np.ndarray, ...]]:
    """(chances, roots) of whole subtrees, given their distinct grams in order and the training counts.

    ``chances[j, b]`` is the chance of a one, mixed over the depths from ``TOP``
    on, at the b-th decision of gram j. ``roots`` has, for each newest byte and
    decision, the counts of zeros and ones and the sum of ln weighted
    probabilities over the subtrees.
    """
    held = levels(grams, learnt)
    chances = np.empty((len(grams), 8))
    roots = []
    for b in range(8):
        below = None  # ln weighted probability of the nodes one deeper, and a gram of each
        nodes = []
        for at, level in enumerate(held):
            key = level.codes >> (8 - b)
            new = np.concatenate([[True], key[1:] != key[:-1]])
            first = np.flatnonzero(new)
            node = np.cumsum(new) - 1
            total = np.add.reduceat(level.counts, first)
            ones = np.add.reduceat(level.counts * (level.codes >> (7 - b) & 1), first)
            weighted, stop = kt_log(total - ones, ones), None
            if at:
                deep, members = below
                weighted, stop = weigh(weighted, np.bincount(node[held[at - 1].up[members]], weights=deep, minlength=len(first)))
            nodes.append((node, estimate(total - ones, ones), stop))
            below = weighted, first
        weighted, first = below
        code = held[-1].codes[first]
        decision = (code >> 8 * TOP) << 8 | 1 << b | (code & 255) >> (8 - b)
        roots.append(_folded(decision, total - ones, ones, weighted))
        mixed = None  # from the top of the subtrees down
        for at in range(len(held) - 1, -1, -1):
            node, est, stop = nodes[at]
            own = est[node] if stop is None else (stop * est)[node]
            if mixed is None:
                mixed, left = own, None if stop is None else (1 - stop)[node]
            else:
                up = held[at].up
                mixed = mixed[up] + left[up] * own
                left = None if stop is None else left[up] * (1 - stop)[node]
        chances[:, b] = mixed
    return chances, tuple(np.concatenate(c) for c in zip(*roots, strict=True))


_SOLVED = "g long, n long, n0 double, n1 double, w double, " + ", ".join(f"q{b} double" for b in range(8))


def _solve_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of grams with their chances, and rows of roots with their decision, less 2^62, in place of the gram."""
    parts = [[c.to_numpy() for c in batch.columns] for batch in batches if batch.num_rows]
    if not parts:
        return
    grams, n, learnt = (np.concatenate(c) for c in zip(*parts, strict=True))
    parts.clear()
    order = np.argsort(grams)
    grams, n, learnt = grams[order], n[order], learnt[order]
    chances, (decision, n0, n1, weighted) = solve(grams, learnt)
    names = [c.split()[0] for c in _SOLVED.split(", ")]
    none = lambda size: [pa.nulls(size, pa.float64())]
    for at in range(0, len(grams), 1 << 16):
        part = slice(at, at + (1 << 16))
        size = len(grams[part])
        yield pa.RecordBatch.from_arrays([pa.array(grams[part]), pa.array(n[part]), *none(size) * 3, *(pa.array(chances[part, b]) for b in range(8))], names=names)
    size = len(decision)
    yield pa.RecordBatch.from_arrays([pa.array(decision - (1 << 62)), pa.nulls(size, pa.int64()), pa.array(n0), pa.array(n1), pa.array(weighted), *none(size) * 8], names=names)


def crown(decision: np.ndarray, n0: np.ndarray, n1: np.ndarray, children: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(done, left) by newest byte and decision: what the depths above the subtrees say, and the weight they leave to them."""
    done, left = np.zeros(1 << 16), np.ones(1 << 16)
    if not len(decision):
        return done, left
    at = decision & 255
    weighted, stop = weigh(kt_log(n0, n1), children)
    sums = [np.bincount(at, weights=c, minlength=256) for c in (n0, n1, weighted)]
    _, first = weigh(kt_log(sums[0], sums[1]), sums[2])
    root = first * estimate(sums[0], sums[1])
    done[decision] = root[at] + (1 - first[at]) * stop * estimate(n0, n1)
    left[decision] = (1 - first[at]) * (1 - stop)
    return done, left


def logs_of(grams: np.ndarray, chances: np.ndarray, done: np.ndarray, left: np.ndarray) -> np.ndarray:
    """log10 of each gram's byte after its context."""
    out = np.zeros(len(grams))
    byte, newest = grams & 255, (grams >> 8 * DEPTH) << 8
    for b in range(8):
        decision = newest | 1 << b | byte >> (8 - b)
        one = done[decision] + left[decision] * chances[:, b]
        out += np.log10(np.where(byte >> (7 - b) & 1, one, 1 - one))
    return out


def gram_logs(counts: DataFrame) -> DataFrame:
    """``g, n, v``: each gram's places and log10 of its byte after its context, under the whole tree."""
    spark = counts.sparkSession
    tasks = max(1, math.ceil(counts.count() / GRAMS_A_TASK))
    subtree = F.shiftright("g", 8 * (DEPTH - TOP + 1))
    solved = written(counts.repartition(tasks, subtree).mapInArrow(_solve_rows, _SOLVED), "solved")
    roots = solved.where("g < 0").groupBy("g").agg(*[F.sum(c).alias(c) for c in ("n0", "n1", "w")]).toPandas()  # at most 65,536
    above = spark.sparkContext.broadcast(crown(roots["g"].to_numpy(np.int64) + (1 << 62), *(roots[c].to_numpy(np.float64) for c in ("n0", "n1", "w"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, left = above.value
        for batch in batches:
            grams = batch.column(0).to_numpy()
            chances = np.stack([batch.column(2 + b).to_numpy() for b in range(8)], axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(logs_of(grams, chances, done, left))], names=["g", "n", "v"])

    return solved.where("g >= 0").select("g", "n", *[f"q{b}" for b in range(8)]).mapInArrow(run, "g long, n long, v double")


class Head:
    """The logs of some grams, found by a hash: grams are laid out by their slot, and a slot's follow each other."""

    def __init__(self, grams: np.ndarray, logs: np.ndarray):
        self._bits = max(1, int(2 * len(grams)).bit_length())
        slots = self._slot(grams)
        order = np.argsort(slots, kind="stable")
        self._grams = np.concatenate([grams[order], [-1]])
        self._logs = np.concatenate([logs[order], [0.0]]).astype(np.float32)
        self._first = np.searchsorted(slots[order], np.arange((1 << self._bits) + 1)).astype(np.int32)

    def _slot(self, grams: np.ndarray) -> np.ndarray:
        return (grams.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self._bits)).astype(np.int64)

    def find(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(log10 of each gram, nought if it is not here; the places of those that are not)."""
        slot = self._slot(grams)
        at, end = self._first[slot], self._first[slot + 1]
        out = np.zeros(len(grams))
        waiting = np.arange(len(grams))
        missing = []
        while len(waiting):
            over = at >= end
            if over.any():
                missing.append(waiting[over])
                waiting, at, end = waiting[~over], at[~over], end[~over]
            hit = self._grams[at] == grams[waiting]
            out[waiting[hit]] = self._logs[at[hit]]
            waiting, at, end = waiting[~hit], at[~hit] + 1, end[~hit]
        return out, np.sort(np.concatenate(missing)) if missing else np.zeros(0, np.int64)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows(found: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], names=["word", "n"])

    seen: Counter = Counter()
    for batch in batches:
        for text in _lowered(batch.column(0).to_pylist()):
            seen.update(text.split())
            if len(seen) > 500_000:
                yield rows(seen)
                seen = Counter()
    if seen:
        yield rows(seen)


def word_counts(training: DataFrame, text_col: str) -> DataFrame:
    """``word, n`` over all training texts, folded per task before the shuffle."""
    rows = training.select(named(text_col).cast("string").alias("t")).mapInArrow(_count_words, "word binary, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n"))


def held_out(id_col: str = "doc_id") -> Column:
    """Every fifth document, by crc32 of its id as text, is scored but not learnt from."""
    return F.crc32(F.coalesce(named(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 1


def _score_rows(head, words):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, known = Head(*head.value), words.value
        for batch in batches:
            at = 0
            for texts in batched(_lowered(batch.column(2).to_pylist())):
                n_tokens, n_head, gain, tails = [], [], [], []
                for t in texts:
                    found = t.split()
                    logs = list(map(known.get, found))
                    tail = [w for w, x in zip(found, logs, strict=True) if x is None]
                    n_tokens.append(len(found) + 1)
                    n_head.append(len(found) - len(tail))
                    gain.append(sum(x for x in logs if x is not None) if tail else sum(logs))
                    tails.append(tail)
                grams, places = grams_of(texts)
                values, rare = model.find(grams)
                ends = np.cumsum(places)
                sums = np.concatenate([[0.0], np.cumsum(values)])
                offsets = np.concatenate([[0], np.searchsorted(rare, ends)])
                columns = [
                    batch.column(0).slice(at, len(texts)),
                    batch.column(1).slice(at, len(texts)),
                    pa.array(sums[ends] - sums[ends - places]),
                    pa.array([len(t) for t in texts], pa.int64()),
                    pa.array(n_tokens, pa.int64()),
                    pa.array(n_head, pa.int64()),
                    pa.array(gain, pa.float64()),
                    pa.array(tails, pa.list_(pa.binary())),
                    pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(grams[rare])),
                ]
                at += len(texts)
                names = ["doc_id", "held_out", "score", "n_bytes", "n_tokens", "n_head", "gain", "tail", "rare"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def _least(counts: DataFrame, most: int) -> int:
    """The least count ``n``, a power of two, that at most ``most`` rows reach."""
    bins = counts.groupBy(F.floor(F.log2("n")).cast("int").alias("b")).agg(F.count(F.lit(1)).alias("k")).collect()
    sizes, total, least = {r["b"]: r["k"] for r in bins}, 0, 1 << 62
    for b in sorted(sizes, reverse=True):
        total += sizes[b]
        if total > most:
            break
        least = 1 << b
    return least


def score_documents(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", head_words: int = 200_000, head_grams: int = 2_000_000) -> DataFrame:
    """One row per input row with the text's log10 probability under the tree, and under a word unigram.

    ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score,
    n_bytes, bits_per_byte``. Null counts as empty: one end and nothing else.
    Training texts are all that are not held out; with none of them every
    decision is even and no word is known. Repeated rows stay; texts of any
    length are read whole; other columns are not read; an empty table gives an
    empty result.

    The tree has a node for every context of the training texts. What is
    broadcast has a bound that the corpus does not move: the logs of the
    ``head_grams`` commonest grams (12 bytes each) and ``head_words`` words.
    Rarer ones are met by a join.
    """
    spark = documents.sparkSession
    rows = documents.select(named(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), text_or_empty(text_col).alias("t"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    training = rows.where(~F.col("held_out")).select("t")

    counts = written(gram_counts(rows.select((~F.col("held_out")).alias("learn"), "t")), "grams")
    logs = written(gram_logs(counts), "logs")
    least = _least(logs, head_grams)
    common = logs.where(F.col("n") >= least).select("g", F.col("v").cast("float").alias("v")).toArrow()
    grams = spark.sparkContext.broadcast((common["g"].to_numpy(), common["v"].to_numpy()))
    words = written(word_counts(training, "t"), "words")
    totals = words.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).first()
    ends = training.count()
    n_train, distinct = int((totals["n"] or 0) + ends), int(totals["v"] + (ends > 0))
    least_word = _least(words, head_words)
    gain = lambda n: np.log10(n + 0.5) - np.log10(0.5)  # noqa: E731  over a word that was never seen
    common = words.where(F.col("n") >= least_word).toArrow()
    head = spark.sparkContext.broadcast(dict(zip(common["word"].to_pylist(), gain(common["n"].to_numpy()).tolist(), strict=True)))
    del common

    out = f"doc_id {kind}, held_out boolean, score double, n_bytes long, n_tokens long, n_head long, gain double, tail array<binary>, rare array<long>"
    scored = written(rows.mapInArrow(_score_rows(grams, head), out).withColumn("rid", F.monotonically_increasing_id()), "scored")
    tail = scored.select("rid", F.explode("tail").alias("word")).join(words.where(F.col("n") < least_word), "word")
    tail = tail.groupBy("rid").agg(F.count(F.lit(1)).alias("n_tail"), F.sum(F.log10(F.col("n") + 0.5) - F.lit(float(np.log10(0.5)))).alias("tail_gain"))
    rare = scored.select("rid", F.explode("rare").alias("g")).join(logs.where(F.col("n") < least).select("g", "v"), "g")
    rare = rare.groupBy("rid").agg(F.sum("v").alias("rare_score"))
    full = scored.drop("tail", "rare").join(tail, "rid", "left").join(rare, "rid", "left")
    unseen = float(np.log10(0.5) - np.log10(n_train + 0.5 * (distinct + 1)))
    base = F.col("n_tokens") * F.lit(unseen) + F.col("gain") + F.coalesce("tail_gain", F.lit(0.0)) + F.lit(float(gain(ends)))
    score = F.col("score") + F.coalesce("rare_score", F.lit(0.0))
    return full.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_head") + F.coalesce("n_tail", F.lit(0)) + F.lit(int(ends > 0))).cast("long").alias("n_known"),
        F.lit(n_train).cast("long").alias("train_tokens"),
        base.alias("base_score"),
        score.alias("score"),
        "n_bytes",
        (-score / F.lit(float(np.log10(2.0))) / (F.col("n_bytes") + 1)).alias("bits_per_byte"),
    )
