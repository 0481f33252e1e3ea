import corpus_pipeline
from barloom.llm import language, packing

from .test_line_repeats import plain as dropped_lines
from .test_near_copies import plain_classes
from .test_quality import plain as quality_of


QUALITY, LANGUAGE, LINES, NEAR, PACKING = (stage for _, stage in corpus_pipeline.STAGES)


def texts_of(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_stages_match_their_brute_force_twins(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    good = QUALITY(spark, docs, sf_dir)
    want = {i: t for i, t in rows.items() if quality_of(t)[-1]}
    assert texts_of(good) == want
    field = language.train(good)
    found = dict(zip(want, language.Tagger(field).texts(list(want.values())), strict=True))
    want = {i: t for i, t in want.items() if found[i][0] != "und" and found[i][1] >= 0.5}
    known = LANGUAGE(spark, good, sf_dir)
    assert texts_of(known) == want
    gone = dict(dropped_lines(list(want.items())))
    left = {i: "\n".join(s for n, s in enumerate(t.split("\n")) if str(n) not in gone[i].split(",")) for i, t in want.items()}
    want = {i: t for i, t in left.items() if not gone[i] or t.strip(" \t\n\r\x0b\x0c")}
    lines = LINES(spark, known, sf_dir)
    assert texts_of(lines) == want
    first = set(plain_classes([(t, i) for i, t in want.items()]))
    want = {i: t for i, t in want.items() if i in first}
    single = NEAR(spark, lines, sf_dir)
    assert single.columns == docs.columns
    assert texts_of(single) == want
    packed = corpus_pipeline.run(spark, sf_dir).collect()
    encoder = packing.WordEncoder(packing.default_tokenizer())
    assert {i: sum(r.length for r in packed if r.doc_id == i) for i in want} == {i: len(encoder.encode(t)) // 4 + 1 for i, t in want.items()}
    assert {r.doc_id for r in packed} == set(want)


def test_stages_keep_odd_rows_and_clashing_columns(spark, sf_dir):
    """Null and empty texts go with the first stage; null ids, repeated rows, a very long text and clashing columns come through."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("lang = 'en'").orderBy("doc_id").limit(60).collect()
    kept = [r for r in docs if quality_of(r.text)[-1]]
    rows = [(r.doc_id, r.text, r.lang, "_row", "_text", 1, "dotted") for r in kept]
    long = " ".join(f"{w}{k}" if k % 9 == 0 else w for k, w in enumerate(" ".join(r.text for r in kept).split() * 8))
    rows += [(None, kept[0].text + " and some more", "en", "r", "t", 2, "d"), (9001, None, None, "r", "t", 3, "d"), (9002, "", "en", "r", "t", 4, "d"), rows[1], rows[1], (9003, long, "en", "r", "t", 5, "d")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, _row string, _text string, fp int, `a.b` string")
    now = df
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, sf_dir)
        assert now.columns == df.columns
        found = now.collect()
        assert not {9001, 9002} & {r.doc_id for r in found} and {r._text for r in found} <= {"_text", "t"}
    assert 9003 in {r.doc_id for r in found} and len({(r.doc_id, r.text) for r in found}) == len(found)
    out = PACKING(spark, now, sf_dir).collect()
    assert len({(r.sequence_id, r.offset) for r in out}) == len(out) >= len(found)


def test_stages_take_an_empty_table(spark, sf_dir):
    now = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, sf_dir)
        assert now.count() == 0


def test_stage_list():
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None
