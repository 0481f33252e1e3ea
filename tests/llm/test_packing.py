import random
import zlib

import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from barloom.llm import packing

SCHEMA = "doc_id long, text string, piece string, length int"


@given(st.lists(st.integers(1, 64), max_size=300), st.integers(1, 9))
@settings(max_examples=60, deadline=None)
def test_bins_are_gapless_and_within_capacity(sizes, open_bins):
    bins = packing.BestFit(64, open_bins)
    held = {}
    for n in sizes:
        b, at = bins.put(n)
        assert at == held.get(b, 0)
        held[b] = at + n
        assert held[b] <= 64
    assert len(held) == bins.bins


def test_best_fit_takes_the_tightest_and_closes_the_fullest():
    bins = packing.BestFit(10, 2)
    assert [bins.put(n) for n in (6, 7, 3, 4)] == [(0, 0), (1, 0), (1, 7), (0, 6)]
    bins = packing.BestFit(10, 2)
    assert [bins.put(n)[0] for n in (6, 7, 8, 4, 3)] == [0, 1, 2, 0, 1]
    with pytest.raises(ValueError):
        bins.put(11)


def test_words_encode_as_the_tokenizer():
    whole = Tokenizer.from_file(packing.default_tokenizer())
    mine = packing.WordEncoder(packing.default_tokenizer())
    rng = random.Random(8)
    texts = ["", "  \n\t ", "don't I'LL we'Re 's'", "Ünïcödé’s “quote” 漢字 <|endoftext|> 12 ½ \x1f\x85 İstanbul ΑΣ", "3.14!! ²³ a_b-c", " ­x", "ß ſ ǅ", "<|startoftext|>a"]
    texts += ["".join(rng.choice("aB'sé1 .,\n!漢\x1cÀǆ ") for _ in range(80)) for _ in range(300)]
    for t in texts:
        assert mine.encode(t) == packing._packed(whole.encode(t, add_special_tokens=False).ids), t


def test_all_documents_are_packed_whole(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    odd = [(9000, None), (9001, ""), (9002, "long words " * 9000), (9003, "twice"), (9003, "twice")]
    df = docs.unionByName(spark.createDataFrame(odd, "doc_id long, text string"))
    texts = {r.doc_id: r.text for r in df.collect()}
    whole = Tokenizer.from_file(packing.default_tokenizer())
    out = packing.pack_documents(df, packing.default_tokenizer()).collect()
    want, total = [], 0
    for i, t in [(r.doc_id, r.text) for r in df.collect()]:
        ids = [*whole.encode(t or "", add_special_tokens=False).ids, 1]
        total += len(ids)
        for k in range(0, len(ids), 4096):
            part = ids[k : k + 4096]
            want.append((i, k // 4096, k, len(part), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part))))
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == sorted(want)
    places = {}
    for r in out:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for held in places.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(places) <= 1.05 * total / 4096 + 2
    assert texts[9000] is None


def test_empty_table_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, "some text", "clash", 1), (None, "no id", "clash", 1)], SCHEMA)
    assert packing.pack_documents(df.limit(0), packing.default_tokenizer()).count() == 0
    assert packing.pack_documents(df, packing.default_tokenizer()).count() == 2


def test_groups_are_packed_apart(spark):
    pieces = spark.range(2000).selectExpr("id AS doc_id", "0 AS piece", "0L AS start", "CAST(1 + id % 900 AS LONG) AS length", "id AS ids_crc32")
    out = packing.pack(pieces, per_group=300).collect()
    held = {}
    for r in out:
        held[r.sequence_id] = held.get(r.sequence_id, 0) + r.length
    assert len(out) == 2000 and max(held.values()) <= 4096
    assert len({s >> 32 for s in held}) > 3


def test_equal_pieces_are_dealt_to_many_groups(spark):
    pieces = spark.range(8000).selectExpr("CAST(NULL AS LONG) AS doc_id", "0 AS piece", "0L AS start", "700L AS length", "5L AS ids_crc32")
    sizes = {}
    for r in packing.pack(pieces, per_group=500).collect():
        sizes[r.sequence_id >> 32] = sizes.get(r.sequence_id >> 32, 0) + 1
    assert sum(sizes.values()) == 8000 and len(sizes) == 16 and max(sizes.values()) < 1000


def test_ties_and_a_very_long_text(spark):
    df = spark.createDataFrame([(1, "word " * 50_000), (1, "word " * 50_000), (2, "same"), (3, "same")], "doc_id long, text string")
    out = packing.pack_documents(df, packing.default_tokenizer()).collect()
    assert sum(r.length for r in out) == 2 * 50_001 + 4 and max(r.length for r in out) == 4096
    assert len({(r.sequence_id, r.offset) for r in out}) == len(out)
