"""Edit-aware token counts: a segment tree of pre-token blocks for each document."""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import named, written

#: Characters a leaf has at least; it then ends at the next place where pre-tokens must part.
LEAF_CHARS = 160
#: Pre-token runs whose counts a worker remembers.
RUN_CACHE = 400_000

# The pre-token pattern of the byte-level vocabulary.
PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

# Between a sign that is no blank and a space or line end, pre-tokens always part,
# and neither side's pre-tokens depend on the other.
_PART = re.compile(r"\S(?=[ \n])")
_BLANK_THEN_SPACE = re.compile(r"\s ")


class Counter:
    """Tokens of a stretch of text that begins and ends where pre-tokens part."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self._encode = tiktoken.Encoding("counts", pat_str=PRE_TOKENS, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self._spaced: dict[str, int] = _Runs(lambda run: len(self._encode(" " + run)))

    def whole(self, text: str) -> int:
        return len(self._encode(text))

    def stretch(self, text: str) -> int:
        """As ``whole``; runs after single spaces are counted once each and remembered."""
        if _BLANK_THEN_SPACE.search(text):
            return self.whole(text)
        first, *runs = text.split(" ")
        if "" in runs:  # a space at the end
            return self.whole(text)
        if len(self._spaced) > RUN_CACHE:
            self._spaced.clear()
        return sum(map(self._spaced.__getitem__, runs)) + (self.whole(first) if first else 0)


class _Runs(dict):
    def __init__(self, count: Callable[[str], int]):
        super().__init__()
        self._count = count

    def __missing__(self, run: str) -> int:
        found = self[run] = self._count(run)
        return found


@cache
def counter(path: str) -> Counter:
    """One counter a worker process."""
    return Counter(path)


def leaves(text: str, size: int = LEAF_CHARS) -> list[str]:
    """The text cut where pre-tokens part, each leaf of ``size`` characters or more but the last."""
    out, at = [], 0
    while len(text) - at > size:
        found = _PART.search(text, at + size - 1)
        if not found:
            break
        out.append(text[at : found.end()])
        at = found.end()
    out.append(text[at:])
    return out


class Tree:
    """Sums of characters and tokens over a document's leaves, as a heap-ordered tree.

    Node 1 is the root, node k has children 2k and 2k+1, and the leaves are the
    last level. An edit re-encodes the leaves that it touches and one more on
    either side, whose outer ends no edit moves; if their number stays, only the
    sums on the way to the root change, else the sums are laid out anew. Leaves
    outside the region are never read again.
    """

    def __init__(self, chars: list[int], tokens: list[int]):
        self._lay(chars, tokens)

    @classmethod
    def of(cls, text: str, count: Callable[[str], int]) -> Tree:
        parts = leaves(text)
        return cls([len(p) for p in parts], [count(p) for p in parts])

    def _lay(self, chars: list[int], tokens: list[int]) -> None:
        self.n = len(chars)
        width = 1 << max(0, self.n - 1).bit_length()
        self.width = width
        self.sums = np.zeros((2 * width, 2), dtype=np.int64)
        self.sums[width : width + self.n, 0] = chars
        self.sums[width : width + self.n, 1] = tokens
        level = width
        while level > 1:
            half = level // 2
            self.sums[half:level] = self.sums[level : 2 * level : 2] + self.sums[level + 1 : 2 * level : 2]
            level = half

    @property
    def chars(self) -> int:
        return int(self.sums[1, 0])

    @property
    def tokens(self) -> int:
        return int(self.sums[1, 1])

    def find(self, place: int) -> tuple[int, int]:
        """(leaf, its first character) of the leaf that holds a character; the last leaf for the text's end."""
        node, start = 1, 0
        while node < self.width:
            node *= 2
            if place >= start + self.sums[node, 0] and self.sums[node + 1, 0]:
                start += int(self.sums[node, 0])
                node += 1
        return min(node - self.width, self.n - 1), start

    def edit(self, text: str, place: int, delete: int, insert: str, count: Callable[[str], int]) -> tuple[str, int]:
        """(new text, characters encoded again) of replacing ``delete`` characters at ``place`` by ``insert``."""
        if not 0 <= place <= self.chars or not 0 <= delete <= self.chars - place:
            raise ValueError("the edit lies outside the text")
        new = text[:place] + insert + text[place + delete :]
        first, start = self.find(place)
        last, last_start = self.find(max(place, place + delete - 1))
        if first:
            first -= 1
            start -= int(self.sums[self.width + first, 0])
        end = last_start + int(self.sums[self.width + last, 0])
        if last + 1 < self.n:
            last += 1
            end += int(self.sums[self.width + last, 0])
        parts = leaves(new[start : end + len(insert) - delete])
        sizes, tokens = [len(p) for p in parts], [count(p) for p in parts]
        if len(parts) == last - first + 1:
            self.sums[self.width + first : self.width + last + 1] = list(zip(sizes, tokens, strict=True))
            low, high = self.width + first, self.width + last
            while low > 1:
                low, high = low // 2, high // 2
                self.sums[low : high + 1] = self.sums[2 * low : 2 * high + 2 : 2] + self.sums[2 * low + 1 : 2 * high + 2 : 2]
        else:
            held = self.sums[self.width : self.width + self.n]
            all_chars = [*held[:first, 0].tolist(), *sizes, *held[last + 1 :, 0].tolist()]
            all_tokens = [*held[:first, 1].tolist(), *tokens, *held[last + 1 :, 1].tolist()]
            self._lay(all_chars, all_tokens)
        return new, sum(sizes)

    def leaf_rows(self) -> tuple[list[int], list[int]]:
        held = self.sums[self.width : self.width + self.n]
        return held[:, 0].tolist(), held[:, 1].tolist()


def _build(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path).stretch
        for batch in batches:
            trees = [Tree.of(t or "", count) for t in batch.column(1).to_pylist()]
            rows = [t.leaf_rows() for t in trees]
            columns = [batch.column(0), batch.column(1), pa.array([t.tokens for t in trees], pa.int64())]
            columns += [pa.array([r[k] for r in rows], pa.list_(pa.int32())) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text", "n_tokens", "leaf_chars", "leaf_tokens"])

    return run


def build(documents: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text, n_tokens, leaf_chars, leaf_tokens``: each document with its tree's leaves.

    Null counts as empty (no token, one empty leaf) and stays null. Texts of any
    length are read whole. Repeated rows and null ids stay; other columns are not
    read; an empty table gives an empty result.
    """
    rows = documents.select(named(id_col).alias("doc_id"), named(text_col).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_build(vocabulary), f"doc_id {kind}, {STATE}")


def merged_edits(edits: list[tuple[int, int, int, str]], chars: int) -> list[tuple[int, int, str]]:
    """(place, delete, insert) that touch different characters, the last place first, from ``(seq, place, delete, insert)``.

    Places are characters of the stored text of ``chars``; a place outside it is
    moved to its nearer end and a deletion stops there. What any edit deletes
    goes; insertions stand where they were put, in the order of place and ``seq``,
    even inside a stretch that another edit deletes.
    """
    out: list[list] = []
    for place, seq, delete, insert in sorted((min(max(p, 0), chars), s, d, x) for s, p, d, x in edits):
        end = min(place + max(delete, 0), chars)
        if out and (place == out[-1][0] or place < out[-1][1]):
            out[-1][1] = max(end, out[-1][1])
            out[-1][2] += insert
        else:
            out.append([place, end, insert])
    return [(place, end - place, insert) for place, end, insert in reversed(out)]


STATE = "text string, n_tokens long, leaf_chars array<int>, leaf_tokens array<int>"


def _edit(path: str, edits_of: Callable[[int | None, int, list[dict] | None], list[tuple[int, int, int, str]]]):
    """Applies edits to kept trees; ``edits_of`` gives a row's edits from its id, its characters and its ``edits``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path).stretch
        for batch in batches:
            held = [batch.column(batch.schema.names.index(n)).to_pylist() for n in ("doc_id", "text", "leaf_chars", "leaf_tokens", "edits")]
            texts, totals, chars, tokens, again = [], [], [], [], []
            for doc_id, text, sizes, counts, edits in zip(*held, strict=True):
                tree, redone = Tree(sizes, counts), 0
                for place, delete, insert in merged_edits(edits_of(doc_id, tree.chars, edits), tree.chars):
                    text, n = tree.edit(text or "", place, delete, insert, count)
                    redone += n
                texts.append(text)
                totals.append(tree.tokens)
                own = tree.leaf_rows()
                chars.append(own[0])
                tokens.append(own[1])
                again.append(redone)
            columns = [batch.column(batch.schema.names.index("doc_id")), pa.array(texts, pa.string()), pa.array(totals, pa.int64())]
            columns += [pa.array(chars, pa.list_(pa.int32())), pa.array(tokens, pa.list_(pa.int32())), pa.array(again, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text", "n_tokens", "leaf_chars", "leaf_tokens", "encoded_again"])

    return run


def _listed(doc_id: int | None, chars: int, edits: list[dict] | None) -> list[tuple[int, int, int, str]]:
    return [(e["seq"] or 0, e["place"] or 0, e["delete"] or 0, e["insert"] or "") for e in edits or []]


def apply_edits(state: DataFrame, edits: DataFrame, vocabulary: str) -> DataFrame:
    """``state`` (as ``build`` made it) after ``edits`` (``doc_id, seq, place, delete, insert``), with ``encoded_again``.

    Places are characters of the stored text, so edits of a document do not
    depend on each other's order. ``merged_edits`` says what overlapping edits,
    edits at one place and edits outside the text do; a null number counts as 0
    and a null insertion as empty. A null text counts as empty, and stays null
    without edits. A null id is edited by edits with a null id; rows that share
    an id are all edited. Documents without edits pass through, edits without a
    document have no effect. A document's edits become one list beside its text:
    they change one text, so they meet in one task however many they are.
    """
    lists = edits.groupBy(F.col("doc_id").alias("_doc")).agg(F.collect_list(F.struct("seq", "place", "delete", "insert")).alias("edits"))
    held = state.join(lists, F.col("doc_id").eqNullSafe(F.col("_doc")), "left").drop("_doc")
    kind = state.schema["doc_id"].dataType.simpleString()
    return held.select("doc_id", "text", "leaf_chars", "leaf_tokens", "edits").mapInArrow(_edit(vocabulary, _listed), f"doc_id {kind}, {STATE}, encoded_again long")


def script(doc_id: int | None, chars: int) -> list[tuple[int, int, str]]:
    """Two edits of a document that its id and length decide: (place, delete, insert), the later place first."""
    seed = (0 if doc_id is None else doc_id) * 2654435761 % (1 << 32)
    low, high = sorted((seed % (chars + 1), (seed >> 9) % (chars + 1)))
    first = (low, min(5, high - low), f" edit {seed % 97},")
    return [(high, min(9, chars - high), "it's\n done"), first]


def _scripted(doc_id: int | None, chars: int, edits: list[dict] | None) -> list[tuple[int, int, int, str]]:
    return [(-k, *edit) for k, edit in enumerate(script(doc_id, chars))]


def count_and_edit(documents: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: its tokens, and its tokens after two edits (``script``) of its kept tree.

    ``doc_id, n_chars, n_leaves, n_tokens, edited_tokens, encoded_again``. Trees
    are built and stored beside their texts first; the edits then read the stored
    leaves and encode again only what they touch. No shuffle. Null counts as
    empty; texts of any length are read whole; repeated rows stay; other columns
    are not read; an empty table gives an empty result.
    """
    state = written(build(documents.withColumn(id_col, named(id_col).cast("long")), vocabulary, id_col, text_col), "trees")
    held = state.select("doc_id", "text", "leaf_chars", "leaf_tokens", F.lit(None).cast("array<int>").alias("edits"), "n_tokens")
    out = "doc_id long, n_chars long, n_leaves long, n_tokens long, edited_tokens long, encoded_again long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edit = _edit(vocabulary, _scripted)
        for batch in batches:
            sizes = batch.column(2)
            chars = [sum(x) for x in sizes.to_pylist()]
            for done in edit(iter([batch])):
                columns = [batch.column(0), pa.array(chars, pa.int64()), pa.array([len(x) for x in sizes], pa.int64()), batch.column(5), done.column(2), done.column(5)]
                yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in out.split(", ")])

    return held.mapInArrow(run, out)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")
