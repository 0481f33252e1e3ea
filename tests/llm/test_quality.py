import random
import re

from barloom.llm import quality

SCHEMA = "doc_id long, text string, n_words string, _m int"


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [s for s in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", s)]
    seen = {}
    for i in range(len(words) - 7):
        seen.setdefault(tuple(words[i : i + 8]), []).append(i)
    covered = {k for at in seen.values() if len(at) > 1 for i in at for k in range(i, i + 8)}
    n, symbols = len(words), sum(c in "#*$%&|<>" for w in words for c in w)
    chars, dup = sum(map(len, words)), len(lines) - len(set(lines))
    stop = sum(w.lower() in quality.STOP_WORDS for w in words)
    failed = n < 20 or 100 * len(covered) > 30 * n
    kept = not failed and 2 * n <= chars <= 20 * n and 10 * symbols <= n and 10 * dup <= 6 * len(lines) and 100 * stop >= 3 * n
    return n, chars, symbols, dup, len(covered), failed, kept


def check(spark, rows):
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], SCHEMA)
    got = sorted(tuple(r)[:8] for r in quality.quality_report(df).collect())
    assert got == sorted((i, *plain(t)) for i, t in rows)


def test_matches_plain_counts(spark):
    rng = random.Random(3)
    words = ["the", "and", "le", "x", "été", "a#b", "$$$", "\x1f", "word", "漢字"]
    texts = [None, "", " ", "\n\n", "one", "a b c d e f g h", "a b c d e f g h " * 2, "a " * 30, "same line\nsame line\nsame line "]
    texts += ["".join(rng.choice(words) + rng.choice([" ", "  ", "\n", "\t", "\r\n", "\x0b"]) for _ in range(rng.randrange(120))) for _ in range(60)]
    texts += [" ".join(rng.choice(["p", "q"]) for _ in range(90)) for _ in range(20)]
    texts += [" ".join(f"w{k}" for k in range(5000)) + " the and of " * 400]
    check(spark, list(enumerate(texts)) + [(1, "twice"), (1, "twice")])


def test_whole_documents(spark, sf_dir):
    check(spark, [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()])


def test_filter_keeps_columns_and_clean_rows(spark):
    good = "The cat sat on the mat and the dog sat by the door of the house in the old town near a river."
    df = spark.createDataFrame([(1, good, "x", 1), (2, "short", "y", 2), (3, None, "z", 3)], SCHEMA)
    kept = quality.keep_good(df)
    assert kept.columns == df.columns and [tuple(r) for r in kept.collect()] == [(1, good, "x", 1)]
    assert quality.keep_good(df.limit(0)).count() == 0


def test_no_python_on_the_executors(spark):
    plan = quality.quality_report(spark.createDataFrame([(1, "a", "x", 1)], SCHEMA))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Exchange" not in plan


def test_measures_leave_other_columns_alone(spark):
    df = spark.createDataFrame([("one two three", "t", "w", "l", "j")], "text string, _t string, _w string, _L string, _j string")
    row = quality.with_metrics(df).first()
    assert (row._t, row._w, row["_L"], row._j, row._m.n_words) == ("t", "w", "l", "j", 3)
    assert quality.quality_report(spark.createDataFrame([(1, "word " * 200_000)], "doc_id long, text string")).first().n_words == 200_000
