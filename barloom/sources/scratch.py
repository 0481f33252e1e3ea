"""Tables that a job keeps between its steps, on the storage that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

_local: list[str] = []


def shared_folder(spark: SparkSession, name: str = "stream") -> str:
    """A new folder's path in ``spark.checkpoint.dir``; only a local session may have none and gets a folder of its own."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        if not _local:
            _local.append(tempfile.mkdtemp(prefix="barloom-shared-"))
            atexit.register(shutil.rmtree, _local[0], ignore_errors=True)
        root = _local[0]
    return f"{root.rstrip('/')}/{name}-{uuid4().hex}"


def kept(df: DataFrame, name: str = "step") -> DataFrame:
    """``df`` as a table: its lineage ends there, its size is known, and a lost executor costs a read."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
