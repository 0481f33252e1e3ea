"""What the corpus operators share: scratch tables, hot-key safe joins, word rules.

Every operator reads only the columns it is told to read. Where rows keep their
other columns they travel boxed in one struct, so extra columns of the input,
whatever they are called, never clash with an operator's own.
"""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word of the corpus contracts: a run of anything but the six ASCII blanks.
BLANK = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where a local session names none (unit tests) is a local folder made;
    on a cluster such a folder would not be shared, so that is an error.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    local = tempfile.mkdtemp(prefix="barloom-scratch-")
    atexit.register(shutil.rmtree, local, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(local)
    return scratch_dir(spark)


def written(df: DataFrame, name: str = "t") -> DataFrame:
    """``df`` as a Parquet table in the shared scratch folder.

    This cuts the lineage with replicated storage, so a lost executor costs a
    re-read and not a recomputation, and gives later joins true sizes.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_caches: dict[str, dict] = {}


def worker_cache(name: str) -> dict:
    """A dict that a Python worker keeps between its tasks, until a task of another operator begins."""
    return _caches.setdefault(name, {})


def forget(keeps: str = "") -> None:
    """Drops the caches of other operators and gives free memory back: workers are used again from stage to stage."""
    for name, held in _caches.items():
        if name != keeps:
            held.clear()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def trimmed(run: Callable, keeps: str = "") -> Callable:
    """A function of batches that leaves no idle memory in its worker, neither its own nor that of stages before."""

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget(keeps)
        try:
            yield from run(batches)
        finally:
            forget(keeps)

    return tidy


def small_batches(spark: SparkSession, rows: int = 1_000) -> None:
    """From now on Python workers of this session get so many rows at once at most; texts of 10,000 fill tens of megabytes on both sides."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, rows)


def named(column: str) -> Column:
    """A column by its exact name, dots and all."""
    return F.col("`" + column.replace("`", "``") + "`")


def boxed(df: DataFrame, **own: Column) -> DataFrame:
    """``df`` as one struct column ``_row`` beside the columns ``own``."""
    return df.select(F.struct(*[named(c) for c in df.columns]).alias("_row"), *[c.alias(n) for n, c in own.items()])


def unboxed(df: DataFrame, columns: list[str], **changed: Column) -> DataFrame:
    """The columns of the boxed rows again, some of them replaced."""
    return df.select(*[(changed[c] if c in changed else F.col("_row").getField(c)).alias(c) for c in columns])


def text_or_empty(column: str) -> Column:
    return F.coalesce(named(column).cast("string"), F.lit(""))


def words_of(c: Column) -> Column:
    """The words of a text, in order."""
    return F.filter(F.split(c, BLANK), lambda w: w != "")
