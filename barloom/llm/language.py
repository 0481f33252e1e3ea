"""Language of each word, and of each text, by a linear-chain conditional random field."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import named, trimmed, worker_cache

#: A word is a run of letters (and of other signs that count as alphabetic). Of a longer run every WORD_CHARS
#: letters are a word, so scripts without blanks and very long runs are read whole as well.
WORD_CHARS = 40
_WORDS = re.compile(rf"[^\W\d_]{{1,{WORD_CHARS}}}").findall
#: Slots of the words' lengths.
LENGTHS = 16
UNKNOWN = "und"


@dataclass(frozen=True)
class Settings:
    """How the field is fitted. ``sample_docs`` is the number of labelled texts, about, that it sees, whole."""

    sample_docs: int = 2000
    sequences: int = 2400
    length: int = 48
    epochs: int = 3
    table: int = 1 << 16
    lexicon: int = 400
    rate: float = 0.25
    seed: int = 7


@dataclass(frozen=True)
class Field:
    """Weights by feature slot and language, transitions and starts, all in logs."""

    langs: tuple[str, ...]
    weights: np.ndarray
    moves: np.ndarray
    starts: np.ndarray
    lexicon: dict[str, int]

    @cached_property
    def key(self) -> str:
        """Tells fields apart by what they hold."""
        held = hashlib.sha256(repr((self.langs, sorted(self.lexicon.items()))).encode())
        for table in (self.weights, self.moves, self.starts):
            held.update(table.tobytes())
        return held.hexdigest()


def features(word: str, table: int, lexicon: dict[str, int], langs: int) -> list[int]:
    """Slots of a lower-cased word: affixes, inner n-grams, its length, and its places in the languages' lexicons.

    Affixes are n-grams that touch a mark at the word's start or end.
    """
    marked = f"^{word}$"
    grams = [marked[i : i + n] for n in (2, 3, 4) for i in range(len(marked) - n + 1)]
    slots = [zlib.crc32(g.encode("utf-8", "surrogatepass")) % table for g in grams]
    known = lexicon.get(word, 0)
    slots += [table + k for k in range(known.bit_length()) if known >> k & 1]
    slots.append(table + langs + min(len(word), LENGTHS - 1))
    return slots


def _chain(moves: np.ndarray, starts: np.ndarray, emit: np.ndarray, first: np.ndarray, block: int = 128) -> np.ndarray:
    """Posterior of each label by forward-backward over many texts laid end to end.

    ``emit`` is (words, labels) in logs; ``first`` marks each text's first word,
    where the chain starts anew. The words are cut into equal blocks that advance
    side by side: products of a block's matrices carry the chain over block
    edges, so the result is that of one pass over each whole text.
    """
    n, k = emit.shape
    e = np.exp(emit - emit.max(axis=1, keepdims=True))
    move, start = np.exp(moves - moves.max()), np.exp(starts - starts.max())
    blocks = -(-n // block)
    pad = blocks * block - n
    e = np.concatenate([e, np.ones((pad, k))]).reshape(blocks, block, k)
    anew = np.concatenate([first, np.ones(pad, dtype=bool)]).reshape(blocks, block)

    def scaled(x: np.ndarray) -> np.ndarray:
        return x / x.sum(axis=-1, keepdims=True)

    product = np.broadcast_to(np.eye(k), (blocks, k, k))
    for t in range(block):
        step = np.matmul(product, move)
        step = np.where(anew[:, t, None, None], product.sum(axis=2, keepdims=True) * start, step) * e[:, None, t]
        product = step / step.sum(axis=(1, 2), keepdims=True)
    into, out = np.empty((blocks, k)), np.empty((blocks, k))
    x = np.full(k, 1.0 / k)
    for b in range(blocks):
        into[b] = x
        x = x @ product[b]
        x /= x.sum()
    x = np.full(k, 1.0 / k)
    for b in range(blocks - 1, -1, -1):
        out[b] = x
        x = product[b] @ x
        x /= x.sum()
    ahead = np.empty((block, blocks, k))
    x = into
    for t in range(block):
        x = scaled(np.where(anew[:, t, None], start, x @ move) * e[:, t])
        ahead[t] = x
    back = np.empty((block, blocks, k))
    x = out
    for t in range(block - 1, -1, -1):
        back[t] = x
        y = e[:, t] * x
        x = scaled(np.where(anew[:, t, None], (y * start).sum(axis=1, keepdims=True), y @ move.T))
    both = (ahead * back).transpose(1, 0, 2).reshape(-1, k)[:n]
    return scaled(both)


def fit(samples: list[tuple[str, str]], settings: Settings = Settings()) -> Field:
    """A field from (text, language) rows.

    Training sequences splice short spans of different texts, as code-switched
    text does, so the transitions learn how long a language lasts. A span is
    taken from any place of any text of its language.
    """
    rng = np.random.default_rng(settings.seed)
    langs = tuple(sorted({lang for _, lang in samples}))
    label_of = {lang: k for k, lang in enumerate(langs)}
    numbers = _Numbers()  # texts are kept as the numbers of their words
    by_label: list[list[np.ndarray]] = [[] for _ in langs]
    counts: list[dict[str, int]] = [{} for _ in langs]
    for text, lang in samples:
        words, label = _WORDS(text.lower()), label_of[lang]
        for w in words:
            counts[label][w] = counts[label].get(w, 0) + 1
        if words:
            by_label[label].append(np.fromiter(map(numbers.__getitem__, words), dtype=np.int32, count=len(words)))
    vocabulary = list(numbers)
    lexicon: dict[str, int] = {}
    for label, seen in enumerate(counts):
        for w, _ in sorted(seen.items(), key=lambda x: (-x[1], x[0]))[: settings.lexicon]:
            lexicon[w] = lexicon.get(w, 0) | 1 << label
    k = max(1, len(langs))
    size = settings.table + k + LENGTHS
    weights, moves, starts = np.zeros((size, k)), np.zeros((k, k)), np.zeros(k)
    able = [label for label in range(k) if by_label and by_label[label]]
    if k < 2 or not able:
        return Field(langs, weights.astype(np.float32), moves, starts, lexicon)
    slots: dict[int, list[int]] = {}
    batch, n = 48, settings.length
    for epoch in range(settings.epochs):
        rate = settings.rate / (1 + epoch)
        for _ in range(settings.sequences // batch):
            words, labels = [], []
            for _ in range(batch):
                own: list[int] = []
                tags: list[int] = []
                while len(own) < n:
                    want = able[int(rng.integers(len(able)))]
                    text = by_label[want][int(rng.integers(len(by_label[want])))]
                    at, take = int(rng.integers(len(text))), int(rng.integers(4, 24))
                    own += text[at : at + take].tolist()
                    tags += [want] * len(text[at : at + take])
                words += own[:n]
                labels += tags[:n]
            rows = [slots.get(w) or slots.setdefault(w, features(vocabulary[w], settings.table, lexicon, k)) for w in words]
            flat = np.fromiter((s for r in rows for s in r), dtype=np.int64)
            sizes = np.array([len(r) for r in rows])
            emit = np.add.reduceat(weights[flat], np.concatenate([[0], np.cumsum(sizes)[:-1]])) / np.sqrt(sizes)[:, None]
            first = np.zeros(len(words), dtype=bool)
            first[::n] = True
            post, pairs = _expected(moves, starts, emit.reshape(batch, n, k))
            truth = np.array(labels).reshape(batch, n)
            grad = (np.eye(k)[truth] - post).reshape(-1, k) / np.sqrt(sizes)[:, None]
            np.add.at(weights, flat, rate * np.repeat(grad, sizes, axis=0))
            seen = np.zeros((k, k))
            np.add.at(seen, (truth[:, :-1].ravel(), truth[:, 1:].ravel()), 1)
            moves += rate * (seen - pairs) / (batch * n) * 10
            starts += rate * (np.eye(k)[truth[:, 0]].mean(axis=0) - post[:, 0].mean(axis=0))
    return Field(langs, weights.astype(np.float32), moves, starts, lexicon)


class _Numbers(dict):
    """A number for each word, in the order they come."""

    def __missing__(self, word: str) -> int:
        self[word] = found = len(self)
        return found


def _expected(moves: np.ndarray, starts: np.ndarray, emit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Posteriors (sequence, word, label) and expected transitions of equally long sequences."""
    batch, n, k = emit.shape
    e = np.exp(emit - emit.max(axis=2, keepdims=True))
    move, start = np.exp(moves - moves.max()), np.exp(starts - starts.max())
    ahead, back = np.empty((n, batch, k)), np.empty((n, batch, k))
    x = start * e[:, 0]
    for t in range(n):
        x = x if t == 0 else (x @ move) * e[:, t]
        x = x / x.sum(axis=1, keepdims=True)
        ahead[t] = x
    x = np.ones((batch, k))
    for t in range(n - 1, -1, -1):
        back[t] = x
        x = (e[:, t] * x) @ move.T
        x /= x.sum(axis=1, keepdims=True)
    post = ahead * back
    post /= post.sum(axis=2, keepdims=True)
    joint = ahead[:-1, :, :, None] * move * (e.transpose(1, 0, 2)[1:] * back[1:])[:, :, None, :]
    joint /= joint.sum(axis=(2, 3), keepdims=True)
    return post.transpose(1, 0, 2), joint.sum(axis=(0, 1))


class _Emissions(dict):
    """A number for each word seen; ``rows`` has their log emissions."""

    def __init__(self, field: Field):
        super().__init__()
        self._field, self._langs = field, max(1, len(field.langs))
        self._table = len(field.weights) - self._langs - LENGTHS
        self.rows = np.empty((1 << 12, self._langs), dtype=np.float32)
        self._new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = found = len(self)
        self._new.append(word)
        return found

    def fill(self) -> None:
        if not self._new:
            return
        while len(self) > len(self.rows):
            self.rows = np.concatenate([self.rows, np.empty_like(self.rows)])
        at = len(self) - len(self._new)
        for i in range(0, len(self._new), 20_000):
            part = [features(w, self._table, self._field.lexicon, self._langs) for w in self._new[i : i + 20_000]]
            sizes = np.array([len(r) for r in part])
            flat = np.fromiter((s for r in part for s in r), dtype=np.int64, count=int(sizes.sum()))
            sums = np.add.reduceat(self._field.weights[flat], np.concatenate([[0], np.cumsum(sizes)[:-1]]))
            self.rows[at + i : at + i + len(part)] = sums / np.sqrt(sizes)[:, None]
        self._new.clear()


#: Words whose emissions a worker remembers, and words that are decoded at once.
CACHE, AT_ONCE = 200_000, 250_000
_kept: dict[str, _Emissions] = worker_cache("language")


class Tagger:
    """Applies a field to texts; emissions of a word are worked out once a worker and field."""

    def __init__(self, field: Field):
        self._field = field
        if field.key not in _kept:
            _kept.clear()
            _kept[field.key] = _Emissions(field)
        self._seen = _kept[field.key]

    def words(self, text: str) -> list[tuple[str, np.ndarray]]:
        """Each word with its posterior over the field's languages."""
        found = _WORDS(text.lower())
        return list(zip(found, self._posterior([found]), strict=True)) if found else []

    def _posterior(self, lists: list[list[str]]) -> np.ndarray:
        if len(self._seen) > CACHE:
            self._seen.clear()
        at = np.fromiter((i for words in lists for i in map(self._seen.__getitem__, words)), dtype=np.int64)
        self._seen.fill()
        first = np.zeros(len(at), dtype=bool)
        first[np.concatenate([[0], np.cumsum([len(w) for w in lists])[:-1]])] = True
        return _chain(self._field.moves, self._field.starts, self._seen.rows[at].astype(np.float64), first)

    def texts(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """(language, score) of each text: the label with the highest mean posterior, and that mean."""
        out = [(UNKNOWN, 0.0)] * len(texts)
        if not self._field.langs:
            return out
        held: list[tuple[int, list[str]]] = []
        waiting = 0
        for i, text in enumerate(texts):
            words = _WORDS(text.lower()) if text else []
            if not words or not (any(map(str.isalpha, words)) or any(c.isalpha() for c in text)):
                continue
            held.append((i, words))
            waiting += len(words)
            if waiting >= AT_ONCE:
                self._settle(held, out)
                held, waiting = [], 0
        self._settle(held, out)
        return out

    def _settle(self, held: list[tuple[int, list[str]]], out: list[tuple[str, float]]) -> None:
        if not held:
            return
        sizes = np.array([len(w) for _, w in held])
        post = self._posterior([w for _, w in held])
        mean = np.add.reduceat(post, np.concatenate([[0], np.cumsum(sizes)[:-1]])) / sizes[:, None]
        best = mean.argmax(axis=1)
        for (i, _), b, row in zip(held, best.tolist(), mean, strict=True):
            out[i] = (self._field.langs[b], float(min(1.0, row[b])))


def held_out(id_col: str = "doc_id") -> Column:
    """Every fifth document by crc32 of its id as text is never learnt from."""
    return F.crc32(F.coalesce(named(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def train(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", settings: Settings = Settings()) -> Field:
    """A field fitted on about ``settings.sample_docs`` different texts, the same number of each language as far as it has them.

    A language's texts are chosen by a hash that must lie below the share of its
    different texts that is wanted. Copies share one hash, so they count once
    and no group of copies moves the share; each task sends its few, whatever the
    number of tasks. The chosen texts are read whole. Only fitting samples;
    prediction reads every row. Rows without text or language teach nothing.
    """
    text, lang = (named(c).cast("string") for c in (text_col, lang_col))
    rows = documents.where(~held_out(id_col)).select(F.xxhash64(text).alias("h"), text.alias("t"), lang.alias("l")).where("t IS NOT NULL AND l IS NOT NULL")
    sizes = {r["l"]: r["n"] for r in rows.groupBy("l").agg(F.approx_count_distinct("h", 0.02).alias("n")).collect()}
    if not sizes:
        return fit([], settings)
    each = max(1, settings.sample_docs // len(sizes))
    below = {x: (1 << 63) - 1 if n <= each else int((2 * each / n - 1) * float(1 << 63)) for x, n in sizes.items()}
    limits = documents.sparkSession.createDataFrame(list(below.items()), "l string, _below long")
    chosen = rows.join(F.broadcast(limits), "l").where("h <= _below").select("h", "l", "t").dropDuplicates(["h", "l"]).collect()
    return fit([(r.t, r.l) for r in sorted(chosen)], settings)


def predict(documents: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for each row; the text is all that a prediction sees."""
    model = documents.sparkSession.sparkContext.broadcast(field)
    rows = documents.select(named(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), named(text_col).cast("string").alias("_text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(model.value)
        for batch in batches:
            found = tagger.texts(batch.column(2).to_pylist())
            columns = [batch.column(0), batch.column(1), pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "lang_pred", "score"])

    return rows.mapInArrow(trimmed(run, "language"), f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def identify(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", settings: Settings = Settings()) -> DataFrame:
    """Train on the documents that are not held out and predict all.

    One row per input row; repeated rows stay and null ids stay null. A text that
    is null or has no letter is ``und`` with score 0, as are all texts when no
    document carries a language. Texts of any length are read whole; ties between
    languages go to the first by name. Other columns are not read; an empty table
    gives an empty result.
    """
    return predict(documents, train(documents, id_col, text_col, lang_col, settings), id_col, text_col)


def keep_identified(documents: DataFrame, text_col: str = "text", id_col: str = "doc_id", lang_col: str = "lang", least: float = 0.5, settings: Settings = Settings()) -> DataFrame:
    """The rows whose language is found with a score of ``least`` or more, with all their columns as they came.

    Null texts and texts without a letter go. Null ids, repeated rows and extra
    columns of any name are allowed; without one labelled text no row stays; an
    empty table gives an empty result.
    """
    model = documents.sparkSession.sparkContext.broadcast(train(documents, id_col, text_col, lang_col, settings))
    # places for names: an extra column may be called anything, dots and all
    plain = documents.select(*[named(c).alias(f"c{k}") for k, c in enumerate(documents.columns)])
    at = documents.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(model.value)
        for batch in batches:
            found = tagger.texts(batch.column(at).to_pylist())
            yield batch.filter(pa.array([lang != UNKNOWN and score >= least for lang, score in found], pa.bool_()))

    kept = plain.mapInArrow(trimmed(run, "language"), plain.schema)
    return kept.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(documents.columns)])
