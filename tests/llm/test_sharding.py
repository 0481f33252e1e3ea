import hashlib
import math
import zlib

import pytest
from pyspark.sql import functions as F

from barloom.llm import sharding

SCHEMA = "doc_id long, text string, shard string, _bucket int"


def plain(key, shards):
    def score(s, w):
        h = int(hashlib.md5(f"{'' if key is None else key}:{s}".encode()).hexdigest()[:13], 16)
        return -w / math.log((h + 0.5) / 2**52)

    return max(shards, key=lambda x: (score(*x), -x[0]))[0]


def test_manifest(spark):
    rows = [(i, f"text {i % 5}" * (i % 7), "clash", 1) for i in range(300)] + [(None, None, "x", 1), (7, "", "x", 1), (7, "", "x", 1)]
    out = sharding.shard_manifest(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(out) == len(rows)
    sizes = {}
    for r in out:
        assert r.shard == plain(r.doc_id, [(s, 1.0) for s in range(16)])
        assert r.grown_shard == plain(r.doc_id, [(s, 1.0) for s in range(17)])
        assert r.grown_shard in (r.shard, 16) and r.law == "key"
        sizes.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in sizes.values())
    want = sorted((-1 if i is None else i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.size, r.text_crc32) for r in out) == want
    assert sharding.shard_manifest(spark.createDataFrame([], SCHEMA)).count() == 0


def test_slots_over_many_buckets(spark):
    df = spark.range(5000).select(F.col("id").alias("doc_id"), (F.col("id") % 3).cast("int").alias("shard"), F.lit(1).alias("size"))
    out = sharding.number_slots(df, "shard", "doc_id", ("size",), 5000, 3, per_bucket=10).collect()
    for s in range(3):
        slots = sorted(r.slot for r in out if r.shard == s)
        assert slots == list(range(len(slots)))


def test_weights_share_the_keys(spark):
    shards = [(0, 1.0), (1, 3.0)]
    out = sharding.shard_rows(spark.range(4000).withColumnRenamed("id", "k"), "k", shards)
    share = out.where("shard = 1").count() / 4000
    assert 0.71 < share < 0.79
    more = [*shards, (2, 1.0)]
    both = out.withColumn("next", sharding.rendezvous(F.col("k"), more))
    assert both.where("next <> shard AND next <> 2").count() == 0
    with pytest.raises(ValueError):
        sharding.rendezvous(F.lit(1), [])
    with pytest.raises(ValueError):
        sharding.rendezvous(F.lit(1), [(0, 0.0)])


def test_no_python_on_the_executors(spark):
    plan = sharding.shard_manifest(spark.createDataFrame([(1, "a", "x", 1)], SCHEMA))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_equal_rows_and_long_texts(spark):
    df = spark.range(9000).selectExpr("IF(id < 6000, NULL, id % 50) AS doc_id", "'x' AS text").unionByName(spark.createDataFrame([(77, "long " * 300_000)], "doc_id long, text string"))
    out = sharding.shard_manifest(df).collect()
    slots = {}
    for r in out:
        slots.setdefault(r.shard, []).append(r.slot)
    assert len(out) == 9001 and all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert max(r.size for r in out) == 1_500_001
