import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from rillwork.llm import sharding


def test_assignment_laws(spark, monkeypatch):
    monkeypatch.setattr(sharding, "RUN", 10)
    rows = [(i, "é" * (i % 5)) for i in range(3000)] + [(7, "again")] * 500 + [(None, None), (None, ""), (5000, "x" * 100000)]
    got = sharding.assign(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, shard int")).collect()
    assert sorted((r.doc_id or -1, r["size"], r.text_crc32) for r in got) == sorted((i or -1, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    slots, shards = defaultdict(list), defaultdict(set)
    for r in got:
        slots[r.shard].append(r.slot)
        shards[r.doc_id].add((r.shard, r.grown_shard))
        assert r.grown_shard in (r.shard, 16) and r.law == "key"
    assert all(len(s) == 1 for s in shards.values())
    assert set(slots) == set(range(16)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    moved = sum(a != b for s in shards.values() for a, b in s) / len(shards)
    assert 0.03 < moved < 0.09
    assert sharding.assign(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_weights(spark):
    got = spark.range(20000).select(sharding.shard_of(F.col("id"), [1.0, 3.0]).alias("s")).groupBy("s").count().collect()
    assert 0.73 < {r.s: r["count"] for r in got}[1] / 20000 < 0.77
    with pytest.raises(ValueError):
        sharding.shard_of(F.col("id"), [1.0, 0.0])


def test_write(spark, tmp_path):
    sharding.write_shards(spark.range(1000).withColumnRenamed("id", "doc_id"), str(tmp_path / "s"), [1.0] * 4, files=2)
    assert {r.shard for r in spark.read.parquet(str(tmp_path / "s")).select("shard").distinct().collect()} == {0, 1, 2, 3}
