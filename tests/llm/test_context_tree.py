import math
import random
import zlib

import numpy as np
import pytest

from barloom.llm import context_tree as ct

SCHEMA = "doc_id long, text string, score string, mark int"


def grams(texts):
    """All (depth, context): {byte: n} by plain counting."""
    counts = {}
    for t in texts:
        data = bytes(ct.DEPTH) + t + b"\0"
        for i in range(ct.DEPTH, len(data)):
            for d in range(ct.DEPTH + 1):
                here = counts.setdefault((d, data[i - d : i]), {})
                here[data[i]] = here.get(data[i], 0) + 1
    return counts


def kt(bits):
    n0, n1 = bits
    return math.lgamma(n0 + 0.5) + math.lgamma(n1 + 0.5) - math.log(math.pi) - math.lgamma(n0 + n1 + 1)


def decision(counts, node):
    """(n0, n1) at a decision, by walking every byte's bits."""
    out = [0, 0]
    for byte, n in counts.items():
        at = 1
        for k in range(7, -1, -1):
            bit = byte >> k & 1
            if at == node:
                out[bit] += n
            at = 2 * at + bit
    return out


def plain_log10(counts, context, byte):
    """log10 P(byte | context) by recursion over the context tree, bit by bit; a context without counts has an even chance."""

    def children(key):
        return [k for k in counts if k[0] == key[0] + 1 and k[1][1:] == key[1]]

    def weighted(key, node):
        own = kt(decision(counts[key], node))
        if key[0] == ct.DEPTH:
            return own
        return float(np.logaddexp(math.log(0.5) + own, math.log(0.5) + sum(weighted(k, node) for k in children(key))))

    def one(depth, node):
        key = (depth, context[len(context) - depth :])
        n0, n1 = decision(counts.get(key, {}), node)
        own = (n1 + 0.5) / (n0 + n1 + 1)
        if depth == ct.DEPTH:
            return own
        stop = math.exp(math.log(0.5) + kt((n0, n1)) - weighted(key, node)) if key in counts else 0.5
        return stop * own + (1 - stop) * one(depth + 1, node)

    total, node = 0.0, 1
    for k in range(7, -1, -1):
        bit = byte >> k & 1
        p = one(0, node)
        total += math.log10(p if bit else 1 - p)
        node = 2 * node + bit
    return total


def plain_score(counts, text):
    data = bytes(ct.DEPTH) + text + b"\0"
    return sum(plain_log10(counts, data[i - ct.DEPTH : i], data[i]) for i in range(ct.DEPTH, len(data)))


@pytest.mark.parametrize("head", [0, 20, 10_000])
def test_scores_match_the_recursion(spark, head, monkeypatch):
    monkeypatch.setattr(ct, "GRAMS_A_TASK", 50)
    rng = random.Random(head)
    rows = [(i, "".join(rng.choice("ab c") for _ in range(rng.randrange(30)))) for i in range(14)] + [(20, "é\0x new"), (21, ""), (22, None)]
    train = [(t or "").encode().lower() for i, t in rows if zlib.crc32(str(i).encode()) % 5 != 1]
    assert len(train) < len(rows)
    counts = grams(train)
    found = ct.score_documents(spark.createDataFrame(rows, "doc_id long, text string"), head_words=3, head_grams=head).collect()
    texts = dict(rows)
    for r in found:
        assert r.score == pytest.approx(plain_score(counts, (texts[r.doc_id] or "").encode().lower()), abs=1e-5)


def table(texts, more=()):
    """{gram: log10} of the grams of ``texts``, learnt, and of ``more``, not learnt."""
    codes = np.concatenate([ct.grams_of([t])[0] for t in [*texts, *more]])
    learnt = np.concatenate([np.full(len(t) + 1, float(k < len(texts))) for k, t in enumerate([*texts, *more])])
    codes, learnt = ct._folded(codes, learnt)
    chances, roots = ct.solve(codes, learnt)
    at, *sums = ct._folded(*roots)
    return dict(zip(codes.tolist(), ct.logs_of(codes, chances, *ct.crown(at, *sums)), strict=True))


def test_every_context_is_a_distribution():
    texts, context = [b"the cat sat on the mat", b"a cat"], b"n the"
    every = np.frombuffer(context[::-1], dtype=np.uint8).astype(np.int64)
    code = 0
    for byte in every.tolist():
        code = code << 8 | byte
    codes = np.concatenate([ct.grams_of([t])[0] for t in texts])
    codes, learnt = ct._folded(np.concatenate([codes, (code << 8) + np.arange(256)]), np.concatenate([np.ones(len(codes)), np.zeros(256)]))
    chances, roots = ct.solve(codes, learnt)
    at, *sums = ct._folded(*roots)
    logs = ct.logs_of(codes, chances, *ct.crown(at, *sums))
    assert (10 ** logs[codes >> 8 == code]).sum() == pytest.approx(1)


def test_head_finds_what_it_holds():
    rng = np.random.default_rng(1)
    codes = np.unique(rng.integers(0, 1 << 48, 5000))
    held = ct.Head(codes[::2], np.arange(len(codes[::2]), dtype=float))
    values, missing = held.find(codes)
    assert missing.tolist() == list(range(1, len(codes), 2)) and values[::2].tolist() == list(range(len(codes[::2])))
    assert ct.Head(np.zeros(0, np.int64), np.zeros(0)).find(codes)[1].tolist() == list(range(len(codes)))


def plain_base(rows):
    """(n_tokens, n_known, N, base) per row by plain counting."""
    words = lambda t: (t or "").encode().lower().split()
    train = [t for i, t in rows if zlib.crc32(("" if i is None else str(i)).encode()) % 5 != 1]
    counts = {}
    for t in train:
        for w in [*words(t), None]:
            counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()), len(counts)
    out = []
    for i, t in rows:
        tokens = [*words(t), None]
        base = sum(math.log10((counts.get(w, 0) + 0.5) / (n + 0.5 * (v + 1))) for w in tokens)
        out.append((-1 if i is None else i, len(tokens), sum(w in counts for w in tokens), n, base))
    return sorted(out, key=str)


def check(spark, rows, **kw):
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], SCHEMA)
    found = ct.score_documents(df, **kw).collect()
    got = sorted([(-1 if r.doc_id is None else r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in found], key=str)
    for g, w in zip(got, plain_base(rows), strict=True):
        assert g[:4] == w[:4] and g[4] == pytest.approx(w[4], abs=1e-6)
    return found


def test_base_and_score_over_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    found = check(spark, rows, head_words=500)
    train = [(t or "").encode().lower() for i, t in rows if zlib.crc32(str(i).encode()) % 5 != 1]
    every = [(t or "").encode().lower() for _, t in rows]
    logs = table(train, [t for t in every if t not in set(train)])
    for r in found:
        text = dict(rows)[r.doc_id]
        assert r.score == pytest.approx(sum(logs[g] for g in ct.grams_of([(text or "").encode().lower()])[0].tolist()), rel=1e-6)


def test_held_out_texts_are_coded_better_than_by_words(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    held = ct.score_documents(docs).where("held_out").agg({"score": "sum", "base_score": "sum"}).first()
    assert held["sum(score)"] > held["sum(base_score)"]


def test_a_long_text(spark):
    found = check(spark, [(1, "some words " * 200_000), (2, "x" * 300_000), (3, "other"), (4, None)])
    assert all(r.score < 0 for r in found)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "One two"), (3, "One two"), (None, "one"), (4, "  \n"), (6, "né two"), (7, "new words here")]
    found = check(spark, rows)
    assert all(r.score < 0 for r in found)
    assert ct.score_documents(spark.createDataFrame([], SCHEMA)).count() == 0


def test_nothing_to_learn_from(spark):
    only = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 1)
    found = check(spark, [(only, "ab")])
    assert found[0].score == pytest.approx(3 * 8 * math.log10(0.5), abs=1e-4)
