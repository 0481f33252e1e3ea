import random

import pytest

from barloom.llm import token_trees as tt

ALPHABET = ["a", "word", " ", "  ", "\n", "\t", "'s", "'re", "12", "é", "漢", "!?", " ", " ", " ", "\x1f", "🎉", "long" * 30, " the", ".\n"]


@pytest.fixture(scope="module")
def count():
    return tt.counter(tt.default_vocabulary())


def random_text(rng, n):
    return "".join(rng.choice(ALPHABET) for _ in range(n))


def test_stretches_add_up(count):
    rng = random.Random(4)
    for _ in range(300):
        text = random_text(rng, rng.randrange(120))
        parts = tt.leaves(text, 20)
        assert "".join(parts) == text
        assert sum(map(count.stretch, parts)) == count.whole(text)
        assert sum(map(count.whole, parts)) == count.whole(text)


def test_edits_equal_a_full_recount(count):
    rng = random.Random(9)
    for _ in range(60):
        text = random_text(rng, rng.randrange(900))
        tree = tt.Tree.of(text, count.stretch)
        for _ in range(12):
            place = rng.randrange(len(text) + 1)
            delete = rng.randrange(min(600, len(text) - place) + 1) if rng.random() < 0.5 else 0
            insert = random_text(rng, rng.randrange(60)) if rng.random() < 0.7 else ""
            text, redone = tree.edit(text, place, delete, insert, count.stretch)
            assert (tree.tokens, tree.chars) == (count.whole(text), len(text))
            assert redone <= len(text)


def test_an_edit_reads_only_its_region(count):
    text = "some plain words here " * 2000
    tree = tt.Tree.of(text, count.stretch)
    _, redone = tree.edit(text, 20_000, 3, "x y", count.stretch)
    assert redone < 8 * tt.LEAF_CHARS
    with pytest.raises(ValueError):
        tree.edit(text, len(text) + 1, 0, "", count.stretch)


def test_edits_of_a_table(spark, count):
    rng = random.Random(2)
    rows = [(i, random_text(rng, 300), "clash") for i in range(20)] + [(50, None, "x"), (51, "", "x"), (7, "again", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, edits string")
    state = tt.build(df, tt.default_vocabulary())
    assert sorted((r.doc_id, r.n_tokens) for r in state.collect()) == sorted((i, count.whole(t or "")) for i, t, _ in rows)
    edits = [(i, k, k, 0, f"<{i} {k}>") for i in (0, 3, 51, 99) for k in (0, 0)]
    out = {(r.doc_id, r.text): r for r in tt.apply_edits(state, spark.createDataFrame(edits, "doc_id long, seq int, place int, delete int, insert string"), tt.default_vocabulary()).collect()}
    assert len(out) == len(rows)
    texts = {r.doc_id: r for r in out.values()}
    assert texts[51].text == "<51 0><51 0>" and texts[50].text is None
    assert all(r.n_tokens == count.whole(r.text or "") for r in out.values())


def test_query_matches_full_counts(spark, sf_dir, count):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(spark.createDataFrame([(None, "no id here"), (9000, None), (9001, ""), (9001, "")], "doc_id long, text string"))
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in tt.count_and_edit(docs, tt.default_vocabulary()).collect():
        text = texts[r.doc_id]
        assert (r.n_chars, r.n_tokens) == (len(text), count.whole(text))
        for place, delete, insert in tt.script(r.doc_id, len(text)):
            text = text[:place] + insert + text[place + delete :]
        assert r.edited_tokens == count.whole(text)
    assert tt.count_and_edit(docs.limit(0), tt.default_vocabulary()).count() == 0


def plain_edits(text, edits):
    """Character by character: what any edit covers goes, insertions stand before the character at their place."""
    n = len(text)
    gone, put = set(), {}
    for seq, place, delete, insert in sorted(edits):
        place = min(max(place, 0), n)
        gone |= set(range(place, min(n, place + max(delete, 0))))
        put[place] = put.get(place, "") + insert
    return "".join(put.get(k, "") + (text[k] if k < n and k not in gone else "") for k in range(n + 1))


def test_overlapping_equal_and_outlying_edits(spark, count):
    text = "abcdefghijklmno"
    cases = [
        [(1, 5, 10, ""), (2, 8, 3, "")],
        [(1, 3, 3, "X"), (2, 3, 0, "YYY")],
        [(1, 99, 4, "end"), (2, -7, 2, "start")],
        [(1, 0, 99, "all"), (2, 4, 2, "in"), (3, 4, 0, "side")],
        [(1, 2, 2, "p"), (2, 4, 2, "q")],
    ]
    rng = random.Random(6)
    cases += [[(k, rng.randrange(-2, 18), rng.randrange(-1, 9), random_text(rng, rng.randrange(3))) for k in range(6)] for _ in range(30)]
    state = tt.build(spark.createDataFrame([(k, text) for k in range(len(cases))] + [(None, "no id"), (None, None)], "doc_id long, text string"), tt.default_vocabulary())
    rows = [(k, *e) for k, edits in enumerate(cases) for e in edits] + [(None, 1, 0, 2, "an"), (None, 2, None, None, None)]
    edits = spark.createDataFrame(rows, "doc_id long, seq int, place int, delete int, insert string")
    out = tt.apply_edits(state, edits, tt.default_vocabulary()).collect()
    assert {r.doc_id: r.text for r in out if r.doc_id is not None} == {k: plain_edits(text, e) for k, e in enumerate(cases)}
    assert sorted(r.text for r in out if r.doc_id is None) == ["an", "an id"]
    assert all(r.n_tokens == count.whole(r.text) and sum(r.leaf_chars) == len(r.text) for r in out)


def test_a_very_long_text(spark, count):
    text = "some plain words here " * 60_000
    row = tt.count_and_edit(spark.createDataFrame([(3, text)], "doc_id long, text string"), tt.default_vocabulary()).first()
    assert row.n_tokens == count.whole(text) and row.encoded_again < 20 * tt.LEAF_CHARS
