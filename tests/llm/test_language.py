import zlib

import numpy as np
import pytest

from barloom.llm import language as lang

SCHEMA = "doc_id long, text string, lang string, score string, held_out int"
SMALL = lang.Settings(sample_docs=150, sequences=480, epochs=2)


def plain_posterior(moves, starts, emit):
    """By summing over all label paths."""
    n, k = emit.shape
    out = np.zeros((n, k))
    for code in range(k**n):
        path = [code // k**t % k for t in range(n)]
        w = starts[path[0]] + sum(emit[t, path[t]] for t in range(n)) + sum(moves[path[t], path[t + 1]] for t in range(n - 1))
        for t in range(n):
            out[t, path[t]] += np.exp(w)
    return out / out.sum(axis=1, keepdims=True)


@pytest.mark.parametrize("block", [1, 3, 128])
def test_chain_is_the_sum_over_paths(block):
    rng = np.random.default_rng(block)
    sizes, k = [5, 1, 4, 2], 3
    moves, starts, emit = rng.normal(size=(k, k)), rng.normal(size=k), 2 * rng.normal(size=(sum(sizes), k))
    first = np.zeros(sum(sizes), dtype=bool)
    first[np.concatenate([[0], np.cumsum(sizes)[:-1]])] = True
    got, at = lang._chain(moves, starts, emit, first, block), 0
    for n in sizes:
        assert np.allclose(got[at : at + n], plain_posterior(moves, starts, emit[at : at + n]))
        at += n


@pytest.fixture(scope="module")
def field(spark, sf_dir):
    return lang.train(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), settings=SMALL)


def test_held_out_accuracy(spark, field):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = lang.predict(docs, field).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 and 0 <= r.score <= 1 for r in rows)
    assert sum(r.lang_pred == r.lang for r in rows) / len(rows) >= 0.97


def test_labels_switch_within_a_text(spark, field):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("lang IN ('en', 'fr')").orderBy("doc_id").collect()
    en = next(r.text for r in docs if r.lang == "en" and len(r.text) > 400)[:300]
    fr = next(r.text for r in docs if r.lang == "fr" and len(r.text) > 400)[:300]
    tagged = lang.Tagger(field).words(en + " " + fr)
    best = [field.langs[p.argmax()] for _, p in tagged]
    n = len(lang._WORDS(en))
    assert best[:n].count("en") / n > 0.9 and best[n:].count("fr") / len(best[n:]) > 0.9


def test_odd_rows(spark, field):
    rows = [(1, None), (2, ""), (3, "12 34 !!"), (4, "½ ²"), (None, "the and of"), (5, "a" * 5000), (6, "twice the"), (6, "twice the")]
    df = spark.createDataFrame([(i, t, "en", "clash", 1) for i, t in rows], SCHEMA)
    out = lang.predict(df, field)
    assert out.columns == ["doc_id", "held_out", "lang_pred", "score"]
    found = {r.doc_id: r.lang_pred for r in out.collect()}
    assert [found[k] for k in (1, 2, 3, 4)] == ["und"] * 4 and found[5] != "und" and out.count() == len(rows)
    assert lang.identify(df.limit(0)).count() == 0
    none = spark.createDataFrame([(1, "some words", None, "x", 1)], SCHEMA)
    assert [tuple(r)[2:] for r in lang.identify(none).collect()] == [("und", 0.0)]
    kept = lang.keep_identified(df, settings=SMALL)
    assert kept.columns == df.columns and kept.where("doc_id <= 4").count() == 0


def test_nothing_but_the_text_is_read(field):
    tagger = lang.Tagger(field)
    assert tagger.texts(["the and with"])[0] == tagger.texts([None, "the and with", ""])[1]


def test_copies_of_one_text_leave_every_language_in_the_sample(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(lang, "fit", lambda samples, settings: seen.append(samples))
    ids = [i for i in range(3000) if zlib.crc32(str(i).encode()) % 5]
    rows = [(i, "the same words again", "en") for i in ids[:2000]] + [(i, f"quelques mots numéro {i}", "fr") for i in ids[2000:2040]] + [(9001, None, "de"), (9002, "ohne", None)]
    lang.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), settings=lang.Settings(sample_docs=30))
    found = [x for _, x in seen[0]]
    assert found.count("en") == 1 and 5 <= found.count("fr") <= 30 and len(found) == found.count("en") + found.count("fr")


def test_many_languages_and_long_runs():
    words = [f"{a}{b}{c}" for a in "bcdfg" for b in "aeiou" for c in "klmn"]
    samples = [(" ".join(words[(7 * k + j) % len(words)] + "qxzw"[k % 4] * (k // 4 + 1) for j in range(40)), f"l{k:02}") for k in range(36)]
    field = lang.fit(samples, lang.Settings(sequences=960, epochs=3))
    assert len(field.langs) == 36 and {bit for w in field.lexicon.values() for bit in range(36) if w >> bit & 1} == set(range(36))
    found = lang.Tagger(field).texts([t for t, _ in samples])
    assert sum(x == y for (x, _), (_, y) in zip(found, samples, strict=True)) >= 30
    assert "".join(lang._WORDS("ab" * 500)) == "ab" * 500 and max(map(len, lang._WORDS("ab" * 500))) == lang.WORD_CHARS
