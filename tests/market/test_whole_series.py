from barloom.operators import resample


def test_blocks_cover_all_returns_of_each_market(spark):
    # the first system pays for 600 bars and loses after them; the short market has fewer bars
    rows = [(s, 1, k, i, float(k == 2) * (1.0 if i < 600 else -3.0)) for s, n in (("a", 1200), ("b", 301)) for k in (2, 3) for i in range(n)]
    df = spark.createDataFrame(rows, "symbol string, short int, long int, i int, ret double")
    out = {r.symbol: r for r in resample.cscv(df, 6, 0).collect()}
    assert out["a"].n_splits == out["b"].n_splits == 20
    assert out["a"].probability > 0 and out["b"].probability == 0
    assert {r.symbol: r.probability for r in resample.cscv(df.where("i < 600"), 6, 0).collect()}["a"] == 0
