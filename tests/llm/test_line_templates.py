from barloom.llm import line_templates as lt

SCHEMA = "doc_id long, text string, _key string, n int"


def run(spark, rows, **kw):
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], SCHEMA)
    out = lt.drop_lines(df, **kw)
    return out


def plain(rows):
    """Line numbers dropped per (id, text) by comparing template sets in plain Python."""
    texts, first = {}, {}
    for i, t in rows:
        for line in (t or "").encode().split(b"\n"):
            for k in lt.templates(line):
                texts.setdefault(k, set()).add(t or "")
                if i is not None:
                    first[k] = min(i, first.get(k, i))
    out = []
    for i, t in rows:
        gone = [n for n, line in enumerate((t or "").encode().split(b"\n")) if any(len(texts[k]) >= lt.MIN_TEXTS and first.get(k) != i for k in lt.templates(line))]
        out.append((-1 if i is None else i, ",".join(map(str, gone))))
    return sorted(out)


def test_templates_generalise_digits_and_one_band():
    assert lt.templates(b" \t") == [] and lt.templates(b"a  b") == [b"2 a b"]
    assert lt.templates(b"Page 12 of 30") == lt.templates(b"Page 7 of two") == [b"4 Page <*> of    <*>"]
    one = b"user logged in from host alpha with role admin at the main site today"
    two = b"user logged in from host omega with role admin at the main site today"
    assert set(lt.templates(one)) & set(lt.templates(two))
    assert not set(lt.templates(one)) & set(lt.templates(one + b" again"))


def test_drops_recurring_templates_but_keeps_the_first(spark):
    rows = [(k, f"{'abcdefgh'[k]} own line of a document\nVisit number {k} of this page\nsigned in from {'abcdefgh'[k]}\nok {'abcdefgh'[k]}") for k in range(5)]
    out = {r.doc_id: r.text for r in run(spark, rows).collect()}
    assert out[0] == rows[0][1]
    assert out[3] == "d own line of a document\nok d"
    # twice only, or in copies of one text, is not recurring
    few = rows[:2] + [rows[0], rows[0]]
    assert sorted(r.text for r in run(spark, few).collect()) == sorted(t for _, t in few)


def test_matches_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted((r.doc_id, r.dropped_lines) for r in lt.line_report(docs).collect()) == plain(rows)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (None, "one two three\nx"), (3, "one two three"), (4, "one two three\nmore words"), (4, "one two three\nmore words")]
    out = run(spark, rows, report=True)
    assert out.columns == ["doc_id", "text", "_key", "n", "_lines", "_dropped"]
    assert sorted((-1 if r.doc_id is None else r.doc_id, ",".join(map(str, r._dropped))) for r in out.collect()) == plain(rows)
    kept = run(spark, rows)
    assert kept.columns == ["doc_id", "text", "_key", "n"]
    assert {r.doc_id for r in kept.collect()} == {1, 2, None, 3, 4}
    assert run(spark, []).count() == 0


def test_a_document_without_words_left_goes(spark):
    rows = [(k, "the very same line") for k in range(1, 3)] + [(3, "the very same line\nand more of it"), (4, "the very same line\n  ")]
    assert sorted((r.doc_id, r.text) for r in run(spark, rows).collect()) == [(1, "the very same line"), (3, "and more of it")]


def test_long_texts_and_clashing_columns(spark):
    lines = [f"line {'abcdefgh'[k % 8]}{k} has words of its own" for k in range(30_000)]
    rows = [(1, "\n".join(lines)), (2, "\n".join(["x " * 200_000, *lines[:2]])), (3, lines[5] + "\nz" * 20_000)]
    df = spark.createDataFrame([(i, t, "a", "b", "c") for i, t in rows], "doc_id long, text string, _row string, _dropped string, _text string")
    out = lt.drop_lines(df, exact_texts=2)
    assert out.columns == df.columns and {r._dropped for r in out.collect()} == {"b"}
    got = {r.doc_id: r.text for r in out.collect()}
    # digits are fields, so document 1 keeps its lines as the first and the others lose theirs; a line of one word is the first's as well
    assert got[1] == rows[0][1] and got[2] == "x " * 200_000 and got[3].count("z") == 20_000


def test_shuffled_templates_give_the_same(spark):
    rows = [(k, f"own {'abcdefgh'[k]} line\nVisit number {k} of this page") for k in range(5)]
    a = sorted(map(tuple, run(spark, rows).collect()))
    assert a == sorted(map(tuple, run(spark, rows, broadcast_templates=0).collect()))
