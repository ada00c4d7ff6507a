"""LAS as a format of Spark: ranges, pushed filters, commits and aborts."""

import os

import pytest
from pyspark.sql import functions as F

from rillwork.sources import las

ROWS = [(i * 0.5, -i * 0.25, i * 1.0, i % 9, i % 4, 1 + i % 3) for i in range(1000)]


def cloud(spark, rows=ROWS):
    return spark.createDataFrame(rows, "x double, y double, z double, intensity int, classification short, return_number short").repartition(4)


def test_written_and_read_by_format(spark, tmp_path, monkeypatch):
    las.register(spark)
    path = str(tmp_path / "c")
    cloud(spark).write.format("las").option("scale", "0.25").option("crs", "LOCAL").mode("append").save(path)
    got = spark.read.format("las").load(path)
    assert sorted(map(tuple, got.collect())) == sorted(ROWS)
    assert {las.las_crs(f"{path}/{f}") for f in os.listdir(path)} == {"LOCAL"} and len(os.listdir(path)) == 4
    some = got.where("classification = 2 and x >= 100 and z < 900 and intensity in (1, 3, 5) and return_number > 1")
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert " Filter (" not in plan
    assert sorted(map(tuple, some.collect())) == sorted(r for r in ROWS if r[4] == 2 and r[0] >= 100 and r[2] < 900 and r[3] in (1, 3, 5) and r[5] > 1)
    assert got.where("x + y > 100").count() == sum(r[0] + r[1] > 100 for r in ROWS)
    assert spark.read.format("las").load(str(tmp_path)).count() == 0


def test_overwriting_leaves_no_stale_parts(spark, tmp_path):
    path = str(tmp_path / "c")
    las.write_las(cloud(spark), path)
    las.write_las(cloud(spark, ROWS[:3]).coalesce(1), path)
    assert las.read_las(spark, path).count() == 3 and len(os.listdir(path)) == 1


def test_a_failing_task_leaves_what_was_there(spark, tmp_path):
    path = str(tmp_path / "c")
    las.write_las(cloud(spark, ROWS[:5]), path)
    before = sorted(os.listdir(path))
    broken = cloud(spark).withColumn("x", F.when(F.col("z") != 700, F.col("x")))
    with pytest.raises(Exception, match="no place"):
        las.write_las(broken, path)
    assert sorted(os.listdir(path)) == before and las.read_las(spark, path).count() == 5


def test_ranges_split_a_file(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "one")
    las.write_las(cloud(spark).coalesce(1), path)
    monkeypatch.setattr(las, "POINTS_A_RANGE", 300)
    parts = las.LasReader(path).partitions()
    assert [(p.first, p.last) for p in parts] == [(0, 300), (300, 600), (600, 900), (900, 1000)]
    assert sum(b.num_rows for p in parts for b in las.LasReader(path).read(p)) == 1000
