"""Best-fit packing of token sequences with a bounded number of open bins."""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import named, trimmed, worker_cache, written

#: Runs and words whose ids a worker remembers; beyond that it forgets them and starts anew.
RUN_CACHE, WORD_CACHE = 150_000, 300_000


def _latin(kind: str) -> str:
    """The characters below U+0250 of a Unicode category, as the inside of a class."""
    return "".join(re.escape(chr(c)) for c in range(0x250) if unicodedata.category(chr(c)).startswith(kind))


class WordEncoder:
    """Ids of a text by its words: each distinct word is encoded once by the tokenizer.

    The tokenizer lower-cases, drops blanks and encodes each pre-token on its
    own, so a text's ids are those of its pre-tokens one after the other. That
    is used where a text has printable ASCII and Latin letters alone and no
    special token; any other text goes to the tokenizer whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self._whole = Tokenizer.from_file(path)
        # U+0130 lower-cases to two characters
        self._plain = re.compile("[\t\n\r -~¡-¬®-įı-ɏ]*")
        self._ids = _RunIds(self._whole)

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if self._plain.fullmatch(text) and "<|" not in text:
            if len(self._ids) > RUN_CACHE:
                self._ids.clear()
            return b"".join(map(self._ids.__getitem__, text.lower().split()))
        return _packed(self._whole.encode(text, add_special_tokens=False).ids)


def _packed(ids: list[int]) -> bytes:
    return b"".join(i.to_bytes(4, "little") for i in ids)


class _WordIds(dict):
    """Ids of a pre-token; a missing one is encoded."""

    def __init__(self, model):
        super().__init__()
        self._model = model
        # the byte-level alphabet: printable bytes stand for themselves, the others follow U+0100
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        hidden = [b for b in range(256) if b not in set(shown)]
        self._alphabet = {b: b for b in shown} | {b: 256 + k for k, b in enumerate(hidden)}

    def __missing__(self, word: str) -> bytes:
        found = self[word] = _packed([t.id for t in self._model.tokenize(word.encode().decode("latin-1").translate(self._alphabet))])
        return found


class _RunIds(dict):
    """Ids of a run without blanks; a missing one is cut into pre-tokens."""

    def __init__(self, tokenizer):
        super().__init__()
        letters, digits = _latin("L"), _latin("N")
        self._cut = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{digits}]|[^\\s{letters}{digits}]+").findall
        self._words = _WordIds(tokenizer.model)

    def __missing__(self, run: str) -> bytes:
        if len(self._words) > WORD_CACHE:
            self._words.clear()
        found = self[run] = b"".join(map(self._words.__getitem__, self._cut(run)))
        return found


def _encoder(path: str) -> WordEncoder:
    """One encoder a worker process, so that later tasks find what earlier ones learnt."""
    held = worker_cache("packing")
    if path not in held:
        held[path] = WordEncoder(path)
    return held[path]


PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


def _cut(tokenizer_path: str, capacity: int, end_id: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = _encoder(tokenizer_path), end_id.to_bytes(4, "little")
        for batch in batches:
            columns: tuple[list, ...] = ([], [], [], [], [])
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids, span = encoder.encode(text or "") + end, 4 * capacity
                for k, at in enumerate(range(0, len(ids), span)):
                    part = ids[at : at + span]
                    for c, v in zip(columns, (doc_id, k, at // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, PIECES.types, strict=True)], schema=PIECES)

    return trimmed(cut, "packing")


def token_pieces(documents: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's ids and end id, cut into pieces of ``capacity`` where longer.

    Rows of ``doc_id, piece, start, length, ids_crc32``; a null or empty text has
    one piece, the end id alone. The ids stay in the task: what goes on is 36
    bytes a piece.
    """
    held = documents.select(named(id_col).cast("long").alias("doc_id"), named(text_col).cast("string").alias("_text"))
    return held.mapInArrow(_cut(tokenizer_path, capacity, end_id), "doc_id long, piece int, start long, length long, ids_crc32 long")


class BestFit:
    """Online best-fit over at most ``open_bins`` bins.

    Bit f of one integer is set while an open bin has f tokens free, so the
    tightest bin that takes an item is the lowest set bit at or above its size
    and the fullest bin is the lowest set bit of all.
    """

    def __init__(self, capacity: int = 4096, open_bins: int = 64):
        if capacity < 1 or open_bins < 1:
            raise ValueError("capacity and open_bins must be positive")
        self.capacity, self.open_bins = capacity, open_bins
        self._free: dict[int, list[int]] = {}
        self._bits = self._open = self.bins = 0

    def _take(self, free: int) -> int:
        stack = self._free[free]
        found = stack.pop()
        if not stack:
            del self._free[free]
            self._bits &= ~(1 << free)
        self._open -= 1
        return found

    def put(self, size: int) -> tuple[int, int]:
        """(bin, offset) of the next item."""
        if not 0 < size <= self.capacity:
            raise ValueError(f"an item has 1 to {self.capacity} tokens, not {size}")
        fits = self._bits >> size
        if fits:
            free = size + (fits & -fits).bit_length() - 1
            found = self._take(free)
        else:
            free, found = self.capacity, self.bins
            self.bins += 1
        left = free - size
        if left:
            if self._open == self.open_bins:  # the fullest closes first, this bin itself if it is that
                fullest = (self._bits & -self._bits).bit_length() - 1
                if left <= fullest:
                    return found, self.capacity - free
                self._take(fullest)
            self._free.setdefault(left, []).append(found)
            self._bits |= 1 << left
            self._open += 1
        return found, self.capacity - free


def _packer(capacity: int, open_bins: int):
    def pack(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["_at", "doc_id", "piece", "ids_crc32"], kind="stable")
        bins = BestFit(capacity, open_bins)
        placed = [bins.put(n) for n in group["length"].tolist()]
        first = int(group["_group"].iloc[0]) << 32
        return group.drop(columns=["_at", "_group"]).assign(sequence_id=[first + b for b, _ in placed], offset=[o for _, o in placed])

    return pack


def pack(pieces: DataFrame, capacity: int = 4096, open_bins: int = 64, per_group: int = 16_384) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``, gapless from 0 in each sequence.

    Pieces are stored and dealt by a hash of their content and their place in
    that table to groups of about ``per_group``, each packed on its own in hash
    order, so a stream of any size keeps all machines busy, no source and no group
    of copies or repeated rows meets in one task, and at most ``open_bins``
    sequences a group end partly filled. Repeated rows are packed as often as they
    come. An empty table gives an empty result.
    """
    stored = written(pieces, "pieces")
    groups = max(1, math.ceil(stored.count() / per_group))
    at = F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id())
    dealt = stored.withColumn("_at", at).withColumn("_group", F.pmod(F.xxhash64("_at"), F.lit(groups)))
    out = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return dealt.groupBy("_group").applyInPandas(_packer(capacity, open_bins), out)


def pack_documents(documents: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1, open_bins: int = 64) -> DataFrame:
    """Tokenize, cut and pack all documents: a row of ``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` for each piece.

    Null and empty texts are one piece, the end id alone; texts of any length are
    encoded whole. Null ids stay null. Repeated rows are packed as often as they
    come, and equal sizes take the bins in the order of their hashes. Other
    columns are not read; an empty table gives an empty result.
    """
    return pack(token_pieces(documents, tokenizer_path, capacity, end_id), capacity, open_bins)


def default_tokenizer(spark: SparkSession | None = None) -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
