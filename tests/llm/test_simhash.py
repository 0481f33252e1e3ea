import random

import xxhash

from barloom.llm import simhash
from barloom.llm.components import connected

SCHEMA = "text string, doc_id long, fp string"


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows):
    marks = [(i, plain_fingerprint(t)) for t, i in rows]
    root = {f: f for _, f in marks}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    fps = list(root)
    for k, a in enumerate(fps):
        for b in fps[k + 1 :]:
            if (a ^ b).bit_count() <= 2:
                root[find(a)] = find(b)
    least = {}
    for i, f in marks:
        if i is not None:
            least[find(f)] = min(i, least.get(find(f), i))
    return sorted(((i if i is not None else -1), f"{f:016x}", least.get(find(f))) for i, f in marks)


def got(df):
    return sorted((r.doc_id if r.doc_id is not None else -1, r.fingerprint, r.component_id) for r in df.collect())


def near_texts(n, seed=5):
    rng = random.Random(seed)
    base = [" ".join(rng.choice(["un", "deux", "trois", "quatre", "cinq", "six"]) + str(rng.randrange(99)) for _ in range(300)) for _ in range(6)]
    out = []
    for k in range(n):
        words = rng.choice(base).split()
        for _ in range(rng.randrange(3)):
            words[rng.randrange(300)] = f"w{rng.randrange(999)}"
        out.append((" ".join(words), k))
    return out


def test_matches_brute_force_on_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.text, r.doc_id) for r in docs.select("text", "doc_id").collect()]
    assert got(simhash.near_duplicates(docs)) == plain_components(rows)


def test_nulls_blanks_repeats_and_clashing_columns(spark):
    rows = [(None, 4), ("", 3), (" \t\n", 9), ("One two", 7), ("one TWO", 5), ("one TWO", 5), (None, None), ("É é x", 1)] + near_texts(60)
    df = spark.createDataFrame([(t, i, "clash") for t, i in rows], SCHEMA)
    assert got(simhash.near_duplicates(df)) == plain_components(rows)


def test_dense_postings_lose_no_link(spark):
    rng = random.Random(1)
    fps = {0x1234567890ABCDEF}
    while len(fps) < 300:
        fps.add(rng.choice(sorted(fps)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
    for _ in range(50):
        fps.add(rng.getrandbits(64))
    df = spark.createDataFrame([(simhash._signed(f),) for f in fps], "fp long")
    fps = sorted(map(simhash._signed, fps))
    want = {}
    for most in (1, 4, 1000):
        found = {r.node: r.root for r in connected(simhash.links(df, most=most)).collect()}
        classes = {}
        for f in fps:
            classes.setdefault(found.get(f, f), set()).add(f)
        want.setdefault("all", sorted(map(sorted, classes.values())))
        assert sorted(map(sorted, classes.values())) == want["all"]
    plain = plain_classes(fps)
    assert want["all"] == plain


def plain_classes(fps):
    left, out = set(fps), []
    while left:
        todo, seen = [left.pop()], set()
        while todo:
            x = todo.pop()
            seen.add(x)
            near = {y for y in left if ((x ^ y) & (2**64 - 1)).bit_count() <= 2}
            left -= near
            todo += near
        out.append(sorted(seen))
    return sorted(out)


def test_components_of_chains_and_stars(spark):
    chain = [(k, k + 1) for k in range(40)]
    star = [(100, k) for k in range(101, 130)]
    edges = spark.createDataFrame(chain + star + [(7, 7), (3, 2)], "a long, b long")
    found = {r.node: r.root for r in connected(edges).collect()}
    assert found == {k: 0 for k in range(41)} | {k: 100 for k in range(100, 130)}
    assert connected(edges.limit(0)).count() == 0


def test_drop_keeps_one_of_each_class(spark):
    rows = near_texts(40) + [("lonely text of its own with words", 500), (None, 600), ("", 601)]
    df = spark.createDataFrame([(t, i, "x") for t, i in rows], SCHEMA)
    want = sorted({c for _, _, c in plain_components(rows)})
    kept = simhash.drop_near_duplicates(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == want
    twice = simhash.drop_near_duplicates(df.unionByName(df))
    assert sorted(r.doc_id for r in twice.collect()) == want
    assert simhash.drop_near_duplicates(df.limit(0)).count() == 0


def test_long_texts_and_an_empty_table(spark):
    long = " ".join(f"w{k % 977}" for k in range(150_000))
    df = spark.createDataFrame([(long, 1, "c"), (long + " end", 2, "c"), (None, 3, "c")], "text string, doc_id long, fp string")
    found = {r.doc_id: r for r in simhash.near_duplicates(df).collect()}
    assert found[1].component_id == found[2].component_id == 1 and found[3].fingerprint == "0" * 16
    assert simhash.near_duplicates(df.limit(0)).count() == 0
