import corpus_pipeline
from barloom.llm import line_templates as lt, queries

WORDS = [f"{'abcdefgh'[k % 8]}{'xyz'[k % 3]}{'klmnopq'[k % 7]}" for k in range(60)]
LONG, VARIED = " ".join(WORDS), " ".join([*WORDS[:-1], "other"])
ROWS = [
    (1, f"first own line here\n{LONG}\nVisit number 1 of this page\nshared by just two"),
    (2, f"second own line here\n{VARIED}\nVisit number 2 of this page\nshared by just two"),
    (3, "third own line here\nOrder 7 was sent\nleft alone here"),
    (4, "fourth own line here\nOrder 7 was sent"),
    (4, "fourth own line here\nOrder 7 was sent"),
]


def plain(rows):
    """Line numbers dropped per (id, text): two texts suffice word for word or for 50 words, three for other templates."""
    texts, first = {}, {}

    def keys(line):
        tokens = line.split()
        out = [(t, 2 if len(tokens) >= 50 else 3) for t in lt.templates(line)]
        return out + [((b"whole", *tokens), 2)] if out else []

    for i, t in rows:
        for line in t.encode().split(b"\n"):
            for k, _ in keys(line):
                texts.setdefault(k, set()).add(t)
                first[k] = min(i, first.get(k, i))
    out = []
    for i, t in rows:
        gone = [n for n, line in enumerate(t.encode().split(b"\n")) if any(len(texts[k]) >= few and first[k] != i for k, few in keys(line))]
        out.append((i, ",".join(map(str, gone))))
    return sorted(out)


def test_two_texts_suffice_for_equal_and_for_long_lines(spark, sf_dir):
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    out = sorted((r.doc_id, r.text) for r in corpus_pipeline.line_dedup(spark, df, sf_dir).collect())
    kept = [ROWS[0], (2, "second own line here\nVisit number 2 of this page"), ROWS[2], (4, "fourth own line here"), (4, "fourth own line here")]
    assert out == kept
    assert sorted((r.doc_id, r.dropped_lines) for r in lt.line_report(df, exact_texts=2).collect()) == plain(ROWS)


def test_query_matches_brute_force(spark, sf_dir):
    rows = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert sorted((r.doc_id, r.dropped_lines) for r in queries.QUERIES["op8_line_templates"](spark, sf_dir).collect()) == plain(rows)
