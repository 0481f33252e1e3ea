import random
import re
import zlib
from collections import Counter

from barloom.llm import queries
from barloom.llm import spelling_variants as sv

SCHEMA = "n long, text string, word string, doc_id long"
RUN = re.compile("[A-Za-zÀ-ÿ]+")


def lower(run):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in run)


def counts_of(rows):
    """Words of (doc_id, text) after the query's damage, with how often they occur."""
    found = Counter()
    for doc, text in rows:
        for run in map(lower, RUN.findall(text or "")):
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 31 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            found[run] += 1
    return {w: n for w, n in found.items() if len(w) >= 7 and n >= 2}


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain(counts):
    words, out, forms = sorted(counts), [], {}
    by_size = {}
    for w in words:
        by_size.setdefault(len(w), []).append(w)
    beside = {w: [v for d in (-1, 0, 1) for v in by_size.get(len(w) + d, ()) if v != w and near(v, w)] for w in words}
    for w in words:
        best = min(beside[w], key=lambda v: (-counts[v], v), default=None)
        forms[w] = best if best is not None and counts[best] >= 10 * counts[w] else None
    for w in words:
        root = w
        while forms[root] is not None:
            root = forms[root]
        out.append((w, forms[w], root, counts[w], len(beside[w]), counts[forms[w]] if forms[w] else None))
    return out


def got(df):
    return sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect())


def test_query_equals_brute_force(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    found = got(queries.op12_spelling_variants(spark, sf_dir))
    assert found == plain(counts_of(rows)) and any(r[1] for r in found)


def test_every_kind_of_edit_runs_and_ties(spark):
    rng = random.Random(4)
    counts = {"aabbaab": 3000, "aabbaabb": 3000, "abbaabé": 5, "letters": 100, "lettters": 10, "leters": 1000}
    for _ in range(400):
        w = list(rng.choice(sorted(counts)))
        at, kind = rng.randrange(len(w)), rng.randrange(3)
        w[at : at + (kind > 0)] = [] if kind == 1 else [rng.choice("abéÿ")]
        counts.setdefault("".join(w), rng.choice([2, 3, 20, 30, 300]))
    counts = {w: n for w, n in counts.items() if w}
    df = spark.createDataFrame(sorted(counts.items()), "word string, n long").repartition(3)
    assert got(sv.variants(df)) == plain(counts)


def test_chains_lead_to_their_ends(spark):
    counts = {"abcdefgh"[:k] + "x" * (8 - k): 10**k for k in range(9)}
    df = spark.createDataFrame(sorted(counts.items()), "word string, n long")
    assert got(sv.variants(df)) == plain(counts)
    forms = spark.createDataFrame([(f"w{k:03}", f"w{k + 1:03}") for k in range(40)], "word string, form string")
    assert {r.root for r in sv.roots(forms).collect()} == {"w040"}


def test_keys_name_the_words_they_stand_for():
    words = ["aab", "ab", "éé", "b", "baab"]
    at, key, own, first, last = sv._keys(words)
    by_text = {}
    for w, k, o, lo, hi in zip(at, key, own, first, last, strict=True):
        texts = {words[w]} if o else {words[w][:p] + words[w][p + 1 :] for p in range(lo, hi + 1)}
        assert len(texts) == 1
        by_text.setdefault(texts.pop(), set()).add(int(k))
    assert all(len(k) == 1 for k in by_text.values()) and len({k for ks in by_text.values() for k in ks}) == len(by_text)


def test_nulls_clashing_columns_and_repeated_rows(spark):
    texts = [None, "", "Recieve receive RECEIVE receive", "naïveté naivété 12 x_underscored_words", "×÷×÷×÷× Straße"]
    rows = [(1, t, "clash", d) for d, t in enumerate(texts * 12)] + [(1, texts[2], "clash", None)] * 30
    df = spark.createDataFrame(rows, SCHEMA)
    want = plain(counts_of([(r[3], r[1]) for r in rows]))
    assert got(sv.spelling_variants(df, damage=True)) == want and want
    assert sv.spelling_variants(df.limit(0)).count() == 0
    assert sv.spelling_variants(df.where("text IS NULL")).count() == 0


def test_a_very_long_word_is_taken_whole(spark):
    rng = random.Random(6)
    long = "".join(rng.choice("abcdefgh") for _ in range(200_000))
    other = long[:150_000] + "z" + long[150_001:]
    df = spark.createDataFrame([(1, f"{long} {long} {other} " * 2 + long * 1, "c", 7)] * 8, SCHEMA)
    counts = Counter(RUN.findall(df.first().text)) 
    found = got(sv.spelling_variants(df))
    assert [(len(w), n, near_n) for w, _, _, n, near_n, _ in found] == [(len(w), 8 * n, 1) for w, n in sorted(counts.items())]
