import glob
import json
import os

import pytest
from pyspark.sql import functions as F

from barloom.functions import symbols
from barloom.operators import indicators as ind
from barloom.sources import exchange, text
from barloom.streaming import bars as minute

GOOD = "20200206 0.03155 0.08918 0.03155 0.03236\n\n20200207,0.03251,0.03311,0.03097,0.0318\n20200208\t0.03261\t0.03297\t0.03192\t0.03257\n"


def file(tmp_path, body, name="MKT.TXT"):
    path = tmp_path / name
    path.write_text(body)
    return str(path)


def test_bars(spark, tmp_path):
    rows = text.read_bars(spark, file(tmp_path, GOOD)).orderBy("i").collect()
    assert [r.i for r in rows] == [0, 1, 2] and rows[0].symbol == "MKT" and rows[1].close == 0.0318
    assert rows[0].x == pytest.approx(-3.4308, abs=1e-3)


@pytest.mark.parametrize("bad", ["2020020x 1 2 1 1\n", "20200209 1 0.5 0.4 0.6\n", "20200209 -1 2 1 1\n", "20200206 1 1 1 1\n", "18991399 1 1 1 1\n"])
def test_bad_bars_fail_or_drop(spark, tmp_path, bad):
    path = file(tmp_path, GOOD + bad)
    with pytest.raises(Exception):
        text.read_bars(spark, path).collect()
    assert text.read_bars(spark, path, policy="drop").count() in (3, 4 if bad.startswith("20200206") else 3)


def test_prices(spark, tmp_path):
    path = file(tmp_path, "20200101 5\n20200102 x 7\n20200103 0\n")
    with pytest.raises(Exception):
        text.read_prices(spark, path).collect()
    assert [r.price for r in text.read_prices(spark, path, "drop").collect()] == [5.0]
    assert [r.price for r in text.read_prices(spark, path, "drop", last_column=True).orderBy("i").collect()] == [5.0, 7.0]
    raw = text.read_prices(spark, path, "drop", keep_raw=True).orderBy("i").collect()
    assert [r.price for r in raw] == [5.0, 0.0] and raw[1].x is None


def test_markets_and_round_trip(spark, tmp_path):
    a, b = file(tmp_path, GOOD, "AAA.TXT"), file(tmp_path, GOOD, "BBB_very_long_market_name.TXT")
    held = text.read_markets(spark, file(tmp_path, f"# list\n{a}\n{b}\n", "list.txt"))
    assert {r.symbol for r in held.select("symbol").distinct().collect()} == {"AAA", "BBB_very_long_m"}
    text.write_bar_text(held, str(tmp_path / "out"))
    back = spark.read.text(str(tmp_path / "out"))
    assert back.where("symbol = 'AAA'").orderBy("value").first().value.startswith("20200206 0.031550 0.089180")
    assert text.price_text(held).count() == 6
    text.save_parameters(spark, [1.0, 2.5, 3.0, 4.0], str(tmp_path / "p"))
    assert text.load_parameters(spark, str(tmp_path / "p")) == [1.0, 2.5, 3.0, 4.0]
    with pytest.raises(ValueError):
        text.save_parameters(spark, [1.0], str(tmp_path / "q"))


def test_csv(spark, tmp_path):
    vendor = file(tmp_path, "Date,Open,High,Low,Close\n2020-01-02,1,2,0.5,1.5\n2020-01-03,,2,0.5,1.5\n", "v.csv")
    assert [(str(r.dt), r.close) for r in text.read_vendor_csv(spark, vendor).collect()] == [("2020-01-02", 1.5)]
    broker = file(tmp_path, "Local time,Open,High,Low,Close,Volume\n02.01.2020 03:04:05.000 GMT+0200,1,2,0.5,1.5,9\nshort,1\n", "b.csv")
    row = text.read_broker_csv(spark, broker).collect()
    assert len(row) == 1 and row[0].close == 1.5 and row[0].ts.hour == 1


def test_klines(spark, tmp_path):
    page = lambda rows: json.dumps({"retCode": 0, "result": {"symbol": "S", "list": [[str(t), "1", "2", "0.5", "1.5", "9", "0"] for t in rows]}})
    answers = spark.createDataFrame([(page([3, 2]),), (page([2, 1]),), (json.dumps({"retCode": 1}),)], "value string")
    assert sorted(r.ts for r in exchange.klines(answers).collect()) == [1, 2, 3]
    tick = json.dumps({"retCode": 0, "result": {"category": "spot", "list": [{"symbol": "XAUTUSDT", "lastPrice": "7.5", "volume24h": "x"}]}})
    row = exchange.tickers(spark.createDataFrame([(tick,)], "value string")).first()
    assert (row.last_price, row.volume) == (7.5, None)
    assert exchange.pages(0, 9, 1, 4) == [(6, 9), (2, 5), (0, 1)]


def kline_archive(spark, path, block=4):
    rows = [(s, t, float(t), t + 1.0, t - 1.0, float(t), 2.0) for s in ("AAA", "BBB") for t in range(25)]
    rows += [r for r in rows if r[1] % 6 < 2]  # pages that overlap
    df = spark.createDataFrame(rows, "symbol string, ts long, open double, high double, low double, close double, volume double")
    exchange.archive(df, path, block=block)
    exchange.register(spark)
    return spark.read.format("klines").options(path=path, limit="7")


def test_pages_of_an_archive_give_each_bar_once(spark, tmp_path):
    read = kline_archive(spark, str(tmp_path / "klines")).load()
    assert read.rdd.getNumPartitions() >= 6
    got = sorted((r.symbol, r.ts, r.open, r.high) for r in read.collect())
    assert got == [(s, t, float(t), t + 1.0) for s in ("AAA", "BBB") for t in range(25)]


def test_filters_and_options_choose_the_bytes_that_are_read(spark, tmp_path):
    path = str(tmp_path / "klines")
    read = kline_archive(spark, path)
    some = read.load().where("symbol = 'BBB' AND ts >= 5 AND ts < 9 AND close <> 7")
    assert sorted((r.symbol, r.ts) for r in some.collect()) == [("BBB", t) for t in (5, 6, 8)]
    assert sorted({r.ts for r in read.options(start="20", end="22").load().collect()}) == [20, 21, 22]
    assert read.load().where("symbol IN ('CCC')").count() == 0
    reader = exchange.KlineReader({"path": path, "limit": "7"})
    left = list(reader.pushFilters([exchange.EqualTo(("symbol",), "BBB"), exchange.GreaterThanOrEqual(("ts",), 5), exchange.LessThan(("ts",), 9), exchange.EqualTo(("close",), 7.0)]))
    assert [f.attribute for f in left] == [("close",)]
    pages = reader.partitions()
    whole = sum(os.path.getsize(f) for f in glob.glob(f"{path}/part-*"))
    taken = []
    for page in pages:
        taken += [(f, a, b) for f, a, b in page.runs]
        rows = [r for batch in reader.read(page) for r in batch.to_pylist()]
        assert all(r["symbol"] == "BBB" and 5 <= r["ts"] < 9 for r in rows)
    assert 0 < sum(b - a for _, a, b in taken) < 0.3 * whole
    every = [run for page in exchange.KlineReader({"path": path}).partitions() for run in page.runs]
    assert sum(b - a for _, a, b in every) == whole and len({(f, a) for f, a, _ in every}) == len(every)


def test_symbols(spark):
    rows = [("XAUTUSDT", True, True), ("TRXUSDT", False, False), ("SPXLUSDT", False, False), ("AAPLXUSDT", True, False)]
    df = spark.createDataFrame([(r[0],) for r in rows], "symbol string")
    found = {r.symbol: (r.a, r.w) for r in df.select("symbol", symbols.allowed(F.col("symbol")).alias("a"), symbols.wanted(F.col("symbol")).alias("w")).collect()}
    assert found == {s: (a, w) for s, a, w in rows}
    kinds = spark.createDataFrame([("DAX",), ("EURUSD",), ("XAUUSDT",), ("ABCUSDT",), ("IBM",)], "s string").select(symbols.classify(F.col("s"))).collect()
    assert [r[0] for r in kinds] == ["index", "forex", "metal", "other", "possible stock"]


def test_trades_to_bars(spark):
    message = json.dumps({"type": "snapshot", "data": [{"T": 60_000 + k * 20_000, "s": "S", "p": p, "v": "2", "S": "Buy"} for k, p in enumerate(["1", "3", "bad", "2"])]})
    bars = minute.minute_bars(minute.parse_trades(spark.createDataFrame([(message,)], "value string"))).orderBy("ts").collect()
    assert [(b.open, b.high, b.low, b.close, b.volume) for b in bars] == [(1.0, 3.0, 0.0, 0.0, 6.0), (2.0, 2.0, 2.0, 2.0, 2.0)]


def test_stream_equals_batch_on_closed_windows(spark, sf_dir, tmp_path):
    from barloom.sources import tables

    ticks = tables.ticks(spark, sf_dir)
    ticks.write.parquet(str(tmp_path / "ticks"))
    stream = minute.minute_bars(minute.tick_stream(spark, str(tmp_path / "ticks"), ticks.schema), "1 hour", "2 hours")
    minute.write_bars(stream, str(tmp_path / "bars"), str(tmp_path / "cp")).awaitTermination()
    got = {(r.symbol, r.ts): (r.open, r.high, r.low, r.close, r.volume) for r in spark.read.parquet(str(tmp_path / "bars")).collect()}
    want = {(r.symbol, r.ts): (r.open, r.high, r.low, r.close, r.volume) for r in minute.minute_bars(ticks, "1 hour").collect()}
    assert got and all(want[k] == v for k, v in got.items()) and len(got) >= 0.98 * len(want)


def test_windows_share_one_sort(spark, sf_dir):
    from barloom.sources import tables

    df = tables.bars(spark, sf_dir).select("symbol", "i", ind.sma("x", 5), ind.slope("x", 10), ind.roc("x", 3))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(symbol") <= 2


def test_order_is_that_of_the_file(spark, tmp_path):
    swapped = file(tmp_path, "20200206 1 1 1 1\n20200208 2 2 2 2\n20200207 3 3 3 3\n20200209 4 4 4 4\n")
    with pytest.raises(Exception):
        text.read_bars(spark, swapped).collect()
    assert [r.close for r in text.read_bars(spark, swapped, policy="drop").orderBy("i").collect()] == [1, 2, 4]
    assert [r.close for r in text.read_bars(spark, swapped, ascending=False).orderBy("i").collect()] == [1, 3, 2, 4]


def test_a_blank_line_may_end_a_file(spark, tmp_path):
    path = file(tmp_path, GOOD)
    assert [r.close for r in text.read_bars(spark, path, to_blank=True).collect()] == [0.03236]


def test_names_that_are_cut_to_the_same_are_refused(spark, tmp_path):
    a, b = file(tmp_path, GOOD, "a_very_long_market_name_1.TXT"), file(tmp_path, GOOD, "a_very_long_market_name_2.TXT")
    with pytest.raises(ValueError):
        text.read_bars(spark, [a, b])


def test_market_list(spark, tmp_path):
    bars = text.read_bars(spark, [file(tmp_path, GOOD, "AAA.TXT"), file(tmp_path, GOOD, "BBB.TXT")])
    text.save_market_list(spark, bars, str(tmp_path), str(tmp_path / "MARKETS"))
    lines = [r.value for r in spark.read.text(str(tmp_path / "MARKETS")).collect()]
    assert lines == [f"{tmp_path}/AAA.TXT", f"{tmp_path}/BBB.TXT"]
