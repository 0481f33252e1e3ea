from barloom.llm import context_tree, exact_dedup, language, quality, sharding, simhash
from barloom.llm.near_copies import drop_near_copies


def test_columns_with_dots_are_read_and_kept(spark):
    text = "The words of this text are many and they stand in some order that the rules can bear with ease for all of us. " * 2
    df = spark.createDataFrame([(1, text, "en", "x"), (2, text + "More.", "en", "y"), (3, None, "de", "z")], "`i.d` long, `te.xt` string, `la.ng` string, `a.b` string")
    own = {"id_col": "i.d", "text_col": "te.xt"}
    assert sharding.shard_manifest(df, **own).count() == exact_dedup.exact_dedup(df, **own).count() == simhash.near_duplicates(df, **own).count() == 3
    assert context_tree.score_documents(df, **own).count() == 3
    assert simhash.drop_near_duplicates(df, **own).columns == df.columns == drop_near_copies(df, **own).columns
    assert quality.keep_good(df, text_col="te.xt").columns == df.columns
    found = language.keep_identified(df, lang_col="la.ng", **own)
    assert found.columns == df.columns and {r["i.d"] for r in found.collect()} <= {1, 2}
