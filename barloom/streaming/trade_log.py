"""Recorded trade messages as a stream: channels of numbered segments on shared storage, read with offsets.

A recorder keeps a folder a channel (a connection to the exchange) and appends
messages, one a line, to segments whose names ascend; a segment is a file or a
folder of files. The stream's offset is a place in each channel, so it starts
again where its checkpoint stands, reads what is new in as many tasks as there
are ranges of bytes, and never reads a line whose end is not written yet.
"""

from __future__ import annotations

import json
import posixpath
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.fs as pa_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..sources.exchange import located

#: Bytes that a task reads at most, and that are read or searched at once.
RANGE_BYTES, READ_BYTES = 32 << 20, 1 << 20


def _files(fs: pa_fs.FileSystem, folder: str) -> dict[str, list[tuple[str, int]]]:
    """Segments of a channel by name, each with the paths and sizes of its files; hidden files are none."""
    found: dict[str, list[tuple[str, int]]] = {}
    for info in fs.get_file_info(pa_fs.FileSelector(folder, recursive=True)):
        parts = posixpath.relpath(info.path, folder).split("/")
        if info.type == pa_fs.FileType.File and not any(p[0] in "._" for p in parts):
            found.setdefault(parts[0], []).append((info.path, info.size))
    return {name: sorted(found[name]) for name in sorted(found)}


class Channel:
    """A channel as it stands: places are (segment, bytes before), a segment's files follow each other."""

    def __init__(self, fs: pa_fs.FileSystem, folder: str):
        self.fs, self.segments = fs, _files(fs, folder)

    def size(self, name: str) -> int:
        return sum(n for _, n in self.segments[name])

    def line_end(self, name: str, at: int) -> int:
        """The end of the last whole line of a segment within its first ``at`` bytes."""
        base = 0
        starts = []
        for path, n in self.segments[name]:
            starts.append((base, path, n))
            base += n
        for base, path, n in reversed(starts):
            end = min(at - base, n)
            with self.fs.open_input_file(path) as held:
                while end > 0:
                    start = max(0, end - READ_BYTES)
                    held.seek(start)
                    cut = held.read(end - start).rfind(b"\n")
                    if cut >= 0:
                        return base + start + cut + 1
                    end = start
        return 0

    def after(self, place: tuple[str, int], segments: int, most: int) -> tuple[str, int]:
        """The place up to which may be read next: so many segments and about so many bytes on, at the end of a line."""
        name, at = place
        left = most
        for n in self.segments:
            begun = place[1] if n == place[0] else 0
            size = self.size(n)
            if n < place[0] or size <= begun:
                continue
            if not segments or left <= 0:
                break
            bound, end = left, 0
            while True:  # a line longer than the bound is read whole
                end = self.line_end(n, min(size, begun + bound))
                if end > begun or begun + bound >= size:
                    break
                bound *= 2
            if end <= begun:
                break
            name, at = n, end
            segments -= 1
            left -= end - begun
            if end < size:
                break
        return name, at

    def ranges(self, start: tuple[str, int], end: tuple[str, int], most: int) -> Iterator[tuple[str, str, int, int, int]]:
        """(segment, path, first, last, bytes before the file) between two places, cut to ``most`` bytes."""
        for name, files in self.segments.items():
            if not start[0] <= name <= end[0]:
                continue
            low = start[1] if name == start[0] else 0
            high = end[1] if name == end[0] else self.size(name)
            base = 0
            for path, n in files:
                a, b = max(0, low - base), min(n, high - base)
                while a < b:
                    yield name, path, a, min(b, a + most), base
                    a += most
                base += n


def lines(fs: pa_fs.FileSystem, path: str, first: int, last: int) -> Iterator[tuple[list[bytes], list[int]]]:
    """Lines that begin in ``[first, last)`` of a file, with their places, some at a time; one that is not ended is none."""
    with fs.open_input_file(path) as held:
        at = max(first - 1, 0)  # a line begins at ``first`` only if the byte before ends one
        held.seek(at)
        begun, rest = first == 0, b""
        while not begun or at < last:
            data = held.read(READ_BYTES)
            if not data:
                return
            rest += data
            if not begun:
                cut = rest.find(b"\n")
                if cut < 0:
                    at, rest = at + len(rest), b""
                    continue
                at, rest, begun = at + cut + 1, rest[cut + 1 :], True
            *whole, rest = rest.split(b"\n")
            places = []
            for line in whole:
                if at >= last:
                    break
                places.append(at)
                at += len(line) + 1
            if places:
                yield whole[: len(places)], places


class _Range(InputPartition):
    def __init__(self, channel: str, segment: str, path: str, first: int, last: int, base: int):
        self.channel, self.segment, self.path, self.first, self.last, self.base = channel, segment, path, first, last, base


class TradeLog(DataSource):
    """``spark.readStream.format("trade_log")``: ``channel, segment, at`` (byte in the segment), ``value`` (the message).

    Options: ``path`` (a folder of channels); ``segments`` and ``bytes``, the most
    of each channel that a batch takes on (all that is there by default); ``progress``, a
    folder beside the checkpoint where the plan of the last batch is kept: Spark
    does not say where a stream starts, so without it the first batch takes all;
    ``range``, the bytes of a task.
    """

    @classmethod
    def name(cls) -> str:
        return "trade_log"

    def schema(self) -> str:
        return "channel string, segment string, at long, value string"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return TradeLogReader(self.options)


class TradeLogReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        o = {k.lower(): v for k, v in options.items()}
        self.path = o["path"].rstrip("/")
        self.segments, self.bytes, self.range = int(o.get("segments", 1 << 40)), int(o.get("bytes", 1 << 60)), int(o.get("range", RANGE_BYTES))
        self.progress = o.get("progress")
        self.planned: dict | None = None  # the end of the last batch planned, if known

    def _channels(self) -> dict[str, Channel]:
        fs, root = located(self.path)
        found = fs.get_file_info(pa_fs.FileSelector(root, allow_not_found=True))
        names = sorted(i.base_name for i in found if i.type == pa_fs.FileType.Directory and i.base_name[0] not in "._")
        return {n: Channel(fs, f"{root}/{n}") for n in names}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        if self.planned is None:
            self.planned = self._kept()
        out = {}
        for name, channel in self._channels().items():
            held = (self.planned or {}).get(name)
            place = (held["segment"], held["at"]) if held else ("", 0)
            if self.planned is None:  # where the stream stands is not known: all that is there
                place = channel.after(place, 1 << 40, 1 << 60)
            else:
                place = channel.after(place, self.segments, self.bytes)
            if place != ("", 0):
                out[name] = {"segment": place[0], "at": place[1]}
        return out

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        place = lambda held, name: (held[name]["segment"], held[name]["at"]) if name in held else ("", 0)
        if any(place(end, n) < place(start, n) for n in start):
            raise ValueError(f"the plan kept in {self.progress} is not that of this checkpoint")
        self.planned = end
        self._keep(end)
        found = []
        for name, channel in self._channels().items():
            if name in end:
                found += [_Range(name, *r) for r in channel.ranges(place(start, name), place(end, name), self.range)]
        return found

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        fs, _ = located(self.path)
        for values, places in lines(fs, partition.path, partition.first, partition.last):
            n = len(values)
            columns = [pa.array([partition.channel] * n, pa.string()), pa.array([partition.segment] * n, pa.string()), pa.array([p + partition.base for p in places], pa.int64())]
            texts = pa.array([v.decode("utf-8", "replace") for v in values], pa.string())
            yield pa.RecordBatch.from_arrays([*columns, texts], names=["channel", "segment", "at", "value"])

    def commit(self, end: dict) -> None:
        self._keep(end)

    def _kept(self) -> dict | None:
        if not self.progress:
            return None
        fs, folder = located(self.progress)
        path = f"{folder.rstrip('/')}/planned.json"
        if fs.get_file_info(path).type != pa_fs.FileType.File:
            return {}  # nothing was planned yet: plans are kept before they run
        with fs.open_input_stream(path) as held:
            return json.loads(held.read())

    def _keep(self, planned: dict) -> None:
        if self.progress:
            fs, folder = located(self.progress)
            folder = folder.rstrip("/")
            fs.create_dir(folder, recursive=True)
            with fs.open_output_stream(f"{folder}/.planned.json") as held:
                held.write(json.dumps(planned).encode())
            fs.move(f"{folder}/.planned.json", f"{folder}/planned.json")


def messages(ticks: DataFrame) -> DataFrame:
    """The messages that the exchange would have sent for ``symbol, ts, seq, price, volume`` and what else ``ticks`` holds: ``value`` beside it."""
    text = lambda c: F.col(c).cast("string")
    trade = F.struct(F.unix_millis("ts").alias("T"), F.col("symbol").alias("s"), text("price").alias("p"), text("volume").alias("v"), F.col("seq").alias("i"))
    whole = F.struct(F.concat(F.lit("publicTrade."), F.col("symbol")).alias("topic"), F.lit("snapshot").alias("type"), F.array(trade).alias("data"))
    return ticks.withColumn("value", F.to_json(whole))


def record(rows: DataFrame, path: str) -> None:
    """Appends ``channel, segment, value`` rows to a log, a folder a segment; segments must follow those that are there."""
    rows.select("channel", "segment", "value").write.mode("append").partitionBy("channel", "segment").text(path)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TradeLog)


def read_log(spark: SparkSession, path: str, **options) -> DataFrame:
    """The log at ``path`` as a stream of messages."""
    register(spark)
    return spark.readStream.format("trade_log").options(path=path, **{k: str(v) for k, v in options.items()}).load()
