import random

import corpus_pipeline
from barloom.llm import near_copies
from barloom.llm.components import connected

SCHEMA = "text string, doc_id long, fp string"


def plain_shingles(text, words=5):
    found = (text or "").encode().lower().split()
    return frozenset(tuple(found[k : k + words]) for k in range(max(1, len(found) - words + 1))) if found else frozenset()


def plain_classes(rows):
    """Smallest id of each class, by comparing all shingle sets."""
    ids = {}
    for t, i in rows:
        s = plain_shingles(t)
        ids[s] = min(i, ids.get(s, i))
    left, out = dict(ids), []
    while left:
        s, i = left.popitem()
        todo, least = [s], i
        while todo:
            x = todo.pop()
            near = [y for y in left if min(len(x), len(y)) >= 0.8 * max(len(x), len(y)) and 5 * len(x & y) >= 4 * len(x | y)]
            for y in near:
                least = min(least, left.pop(y))
            todo += near
        out.append(least)
    return sorted(out)


def edited(n, seed=3, size=120, most=5):
    rng = random.Random(seed)
    base = [[f"w{rng.randrange(500)}" for _ in range(size)] for _ in range(4)]
    out = []
    for k in range(n):
        words = list(rng.choice(base))
        for _ in range(rng.randrange(most)):
            words[rng.randrange(size)] = f"x{rng.randrange(999)}"
        out.append((" ".join(words), k))
    return out


def test_pipeline_stage_drops_copies_that_differ_in_many_bits(spark, sf_dir):
    words = [f"word{k}" for k in range(100)]
    other = [*words[:50], "changed", *words[51:]]
    df = spark.createDataFrame([(" ".join(words), 1, "x"), (" ".join(other), 2, "x")], SCHEMA)
    assert [r.doc_id for r in corpus_pipeline.near_dedup(spark, df, sf_dir).collect()] == [1]


def test_matches_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.text, r.doc_id) for r in docs.select("text", "doc_id").collect()]
    assert sorted(r.doc_id for r in near_copies.drop_near_copies(docs).collect()) == plain_classes(rows)


def test_odd_rows_and_repeats(spark):
    rows = [*edited(40), (None, 600), ("", 601), ("one two", 700), ("One  two", 701)]
    df = spark.createDataFrame([(t, i, "clash") for t, i in rows], SCHEMA)
    want = plain_classes(rows)
    kept = near_copies.drop_near_copies(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == want
    assert sorted(r.doc_id for r in near_copies.drop_near_copies(df.unionByName(df)).collect()) == want
    assert near_copies.drop_near_copies(df.limit(0)).count() == 0


def test_dense_postings_lose_no_class(spark):
    rows = edited(60, seed=8, most=9)
    sets = {near_copies.shingles(t).tobytes(): (k, near_copies.shingles(t)) for t, k in reversed(rows)}.values()
    whole = spark.createDataFrame([(k, [int(x) for x in s]) for k, s in sets], "_u long, set array<long>")
    df = spark.createDataFrame([(k, len(s), [int(x) for x in near_copies._prefix(s, 0.8)]) for k, s in sets], "_u long, _n int, first array<long>")
    want = plain_classes(rows)
    for most in (2, 10, 1000):
        found = {r.node: r.root for r in connected(near_copies.links(df, lambda wanted: whole.join(wanted, "_u"), most=most)).collect()}
        assert sorted({found.get(r._u, r._u) for r in df.collect()}) == want
