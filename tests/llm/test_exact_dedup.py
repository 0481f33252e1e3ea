import hashlib
import random

from barloom.llm import exact_dedup as ed

SCHEMA = "doc_id long, text string, keep_id string, f0 int"


def plain(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    out = []
    for i, t in rows:
        ids = [x for x in groups[t or ""] if x is not None]
        keep = max(ids) if ids else None
        out.append((i, keep, len(groups[t or ""]), i == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=str)


def got(spark, rows, **kw):
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], SCHEMA)
    return sorted((tuple(r) for r in ed.exact_dedup(df, **kw).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()), key=str)


ROWS = [(1, None), (2, ""), (3, "a"), (4, "a"), (4, "a"), (5, "A"), (6, "a "), (7, "é" * 50), (8, "é" * 50), (None, "b"), (9, "b"), (10, "x" * 5000), (11, "x" * 4999 + "y")]


def test_fingerprints_combine():
    rng = random.Random(1)
    data = bytes(rng.randrange(256) for _ in range(10_000))
    for prime in ed.PRIMES:
        whole = int.from_bytes(data, "big") % prime
        for chunk in (1, 7, 4096, 20_000):
            assert ed.fingerprint(data, prime, chunk) == (whole, len(data))


def test_groups_equal_texts(spark):
    assert got(spark, ROWS) == plain(ROWS)
    assert got(spark, []) == []


def test_huge_texts_in_segments(spark):
    assert got(spark, ROWS, segment_bytes=16) == plain(ROWS)


def test_colliding_fingerprints_are_told_apart(spark):
    assert got(spark, ROWS + [(20 + k, f"t{k}") for k in range(30)], primes=(2, 3), chunk_bytes=7) == plain(ROWS + [(20 + k, f"t{k}") for k in range(30)])


def test_shuffled_comparison(spark):
    assert got(spark, ROWS, broadcast_groups=0) == plain(ROWS)


def test_a_very_long_text_and_its_near_copy(spark):
    long = "some words é " * 400_000
    rows = [(1, long), (2, long), (3, long[:-1] + "!"), (4, long)]
    assert got(spark, rows) == plain(rows)
