import json
import os

import pytest

import barloom.plans.catalog  # noqa: F401
from barloom.plans import tool_queries
from barloom.sources import tables
from barloom.streaming import bars as minute
from barloom.streaming import trade_log


def log_of(path, segments):
    """Writes {channel: {segment: bytes}}."""
    for channel, held in segments.items():
        os.makedirs(f"{path}/{channel}", exist_ok=True)
        for name, data in held.items():
            with open(f"{path}/{channel}/{name}", "ab") as out:
                out.write(data)


def read_all(reader, start, end):
    rows = []
    for part in reader.partitions(start, end):
        for batch in reader.read(part):
            rows += zip(*(c.to_pylist() for c in batch.columns), strict=True)
    return rows


def reader_of(path, **options):
    return trade_log.TradeLogReader({"path": str(path)} | {k: str(v) for k, v in options.items()})


def texts(n, of=""):
    return b"".join(f"{of}{k}:{'é' * (k % 7)}\n".encode() for k in range(n))


@pytest.mark.parametrize("most", [1, 3, 10, 1000])
@pytest.mark.parametrize("piece", [4, 1 << 20])
def test_every_line_is_read_once_however_it_is_cut(tmp_path, monkeypatch, most, piece):
    monkeypatch.setattr(trade_log, "READ_BYTES", piece)
    log_of(tmp_path, {"spot": {"a": texts(20), "b": texts(5, "b"), "_hidden": b"x\n"}, "linear": {"a": texts(9, "l")}})
    reader = reader_of(tmp_path, range=most)
    end = {}
    assert reader.initialOffset() == end
    rows = read_all(reader, {}, reader.latestOffset())
    want = [("spot", s, line) for s, data in (("a", texts(20)), ("b", texts(5, "b"))) for line in data.decode().split("\n")[:-1]]
    want += [("linear", "a", line) for line in texts(9, "l").decode().split("\n")[:-1]]
    assert sorted((c, s, v) for c, s, _, v in rows) == sorted(want)
    assert len({(c, s, at) for c, s, at, _ in rows}) == len(rows)


@pytest.mark.parametrize("pace", [{"segments": 1}, {"bytes": 7}, {"bytes": 40, "segments": 2}])
def test_offsets_advance_at_the_pace_that_is_set(tmp_path, pace):
    log_of(tmp_path, {"spot": {"a": texts(20), "b": texts(5), "c": texts(30)}})
    reader = reader_of(tmp_path, progress=tmp_path / "_progress", **pace)
    now, rows, steps = reader.initialOffset(), [], 0
    while (end := reader.latestOffset()) != now:
        rows += read_all(reader, now, end)
        now, steps = end, steps + 1
    assert [r[3] for r in rows] == (texts(20) + texts(5) + texts(30)).decode().split("\n")[:-1]
    assert steps >= 3


def test_a_line_that_is_not_ended_waits(tmp_path):
    log_of(tmp_path, {"spot": {"a": b"one\ntw"}})
    reader = reader_of(tmp_path)
    first = (reader.initialOffset(), reader.latestOffset())[1]
    assert [r[3] for r in read_all(reader, {}, first)] == ["one"]
    log_of(tmp_path, {"spot": {"a": b"o\nthree\n"}, "late": {"z": b"new\n"}})
    assert sorted(r[3] for r in read_all(reader, first, reader.latestOffset())) == ["new", "three", "two"]


def test_a_restarted_reader_keeps_its_pace(tmp_path):
    log_of(tmp_path / "log", {"spot": {n: texts(10, n) for n in "abcd"}})
    options = {"segments": 1, "progress": tmp_path / "progress"}
    reader = reader_of(tmp_path / "log", **options)
    reader.initialOffset()
    first = reader.latestOffset()
    read_all(reader, {}, first)
    again = reader_of(tmp_path / "log", **options)
    assert again.latestOffset()["spot"]["segment"] == "b" and first["spot"]["segment"] == "a"
    with pytest.raises(ValueError):
        again.partitions(again.latestOffset(), first)
    unknown = reader_of(tmp_path / "log", segments=1)
    assert unknown.latestOffset()["spot"]["segment"] == "d"


def test_an_empty_log(tmp_path):
    reader = reader_of(tmp_path / "none")
    assert reader.initialOffset() == reader.latestOffset() == {} and reader.partitions({}, {}) == []


def test_only_snapshots_and_deltas_are_trades(spark):
    trade = {"T": 60_000, "s": "S", "p": "1", "v": "2", "S": "Buy", "i": "7"}
    lines = [json.dumps({"type": k, "data": [trade]}) for k in ("snapshot", "delta", "other")] + ['{"success": true}', "ping", "", None, '{"type": "delta"}']
    found = minute.parse_trades(spark.createDataFrame([(x,) for x in lines], "value string")).collect()
    assert [(r.symbol, r.seq, r.price, r.volume, r.side) for r in found] == [("S", 7, 1.0, 2.0, "Buy")] * 2


def test_bars_over_many_batches_with_a_restart(spark, sf_dir, tmp_path):
    ticks = tables.ticks(spark, sf_dir)
    home = str(tmp_path)
    rows = tool_queries.written_log(tool_queries.recorded(ticks), home)
    ran = tool_queries.run_stream(spark, home, (0, 1), lambda k: rows.where("segment < '00006'" if k == 0 else "segment >= '00006'"))
    assert ran["batches"] >= tool_queries.SEGMENTS + 1
    got = {(r.symbol, r.ts): (r.open, r.high, r.low, r.close, r.volume) for r in spark.read.parquet(f"{home}/bars").collect()}
    want = {(r.symbol, r.ts): (r.open, r.high, r.low, r.close, r.volume) for r in minute.minute_bars(ticks).collect()}
    assert got == want
