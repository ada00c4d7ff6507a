"""Small entries: outlets by x and y, ways back, forced Rho8, stems of an outlet, subsets, counts of one cell, metrics, the older name of filling."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rillwork.grid import GridMeta
from rillwork.operators import basins, conditioning, points, routing, streams
from rillwork.sources import geotiff, tiles


def cells_of(spark, z, name="z"):
    rows = [(int(r), int(c), None if np.isnan(v) else float(v)) for (r, c), v in np.ndenumerate(z)]
    return spark.createDataFrame(rows, f"r int, c int, {name} double")


def test_outlets_by_place(spark):
    grid = GridMeta(4, 5, 100.0, 10.0, 200.0, -20.0)
    at = spark.createDataFrame([(1, 100.0, 200.0), (2, 149.9, 120.1), (3, 150.0, 150.0), (4, 95.0, 150.0), (5, 80.0, 150.0), (6, None, 1.0)], "id long, x double, y double")
    got = {r.id: (r.r, r.c, r.x, r.y) for r in routing.outlets_at(at, grid).collect()}
    assert got[1] == (0, 0, 105.0, 190.0) and got[2] == (3, 4, 145.0, 130.0) and got[4] == (2, 0, 105.0, 150.0)
    for k in (3, 5, 6):
        assert got[k][:2] == (-1, -1) and math.isnan(got[k][2]) and math.isnan(got[k][3])
    assert sorted(r.id for r in routing.pour_points_at(at, grid).collect()) == [1, 2, 4]
    assert routing.outlets_at(at.limit(0), grid).count() == 0


def test_ways_back(spark):
    codes = spark.createDataFrame([(k,) for k in (*range(8), 8, -1, None)], "k int")
    assert [r[0] for r in codes.select(routing.opposite_direction(F.col("k"))).collect()] == [4, 5, 6, 7, 0, 1, 2, 3, None, None, None]


def test_forced_rho8(spark):
    z = np.random.default_rng(2).normal(size=(6, 7))
    cells, grid = cells_of(spark, z), GridMeta(6, 7)
    forced = spark.createDataFrame([(2, 3, 5), (0, 0, 6)], "r int, c int, dir int")
    free = {(r.r, r.c): r.dir for r in routing.flow_direction_rho8(cells, grid, 4).collect()}
    held = {(r.r, r.c): r.dir for r in routing.flow_direction_rho8(cells, grid, 4, forced).collect()}
    assert held == free | {(2, 3): 5, (0, 0): 6}


def test_stem_of_an_outlet(spark):
    # 1 <- 2 <- 3 <- 4, 2 <- 5, and 9 apart; a cell's own column is its row
    rows = [(1, None), (2, 1), (3, 2), (4, 3), (5, 2), (9, None)]
    nodes = spark.createDataFrame([(n, n, 0, 0, p) for n, p in rows], "node long, r int, c int, dir int, ptr long")
    stem = lambda *a: sorted(r.node for r in streams.main_stem(nodes, *a).collect())
    assert stem() == [1, 2, 3, 4] and stem(1) == [1, 2, 3, 4] and stem(3) == [3, 4] and stem(9) == [9] and stem(77) == []


def test_subset(spark):
    cloud = spark.createDataFrame([(1.0, 2.0, 3.0, 2), (4.0, 5.0, 6.0, None)], "x double, y double, z double, classification int")
    assert points.subset(cloud, "classification = 2").collect() == cloud.where("x = 1").collect()
    assert points.subset(cloud, F.col("z") > 1).count() == 2 and points.subset(cloud, F.col("z") > 1).columns == cloud.columns
    with pytest.raises(ValueError):
        points.subset(cloud, "z + 1")


def test_counts_of_single_cells(spark):
    z = np.random.default_rng(9).normal(size=(9, 8))
    cells, grid = cells_of(spark, z), GridMeta(9, 8)
    d8 = routing.flow_direction_d8(cells, grid)
    every = {(r.r, r.c): r.acc for r in routing.accumulate(d8, grid).collect()}
    best = max(every, key=every.get)
    assert basins.upstream_count(d8, grid, *best) == every[best] > 0
    assert basins.upstream_count(d8, grid, 50, 50) == 0


def test_metrics_keep_ids_and_centroids(spark):
    table = spark.createDataFrame([(1, 2.0, 3.0, 4.0, 5.0)], "basin_id long, centroid_x double, centroid_y double, area double, relief double")
    assert basins.metrics(table, ["relief", "unknown"]).columns == ["basin_id", "centroid_x", "centroid_y", "relief"]
    assert basins.metrics(table, []).columns == ["basin_id", "centroid_x", "centroid_y"]


def test_the_older_name_of_filling(spark):
    z = np.random.default_rng(1).normal(size=(7, 7))
    cells, grid = cells_of(spark, z), GridMeta(7, 7)
    key = lambda df: sorted((r.r, r.c, r.z) for r in df.collect())
    assert key(conditioning.fill_sinks(cells, grid)) == key(conditioning.fill_depressions(cells, grid))


def test_hec_ras_is_a_geotiff(spark, tmp_path):
    z = np.random.default_rng(1).normal(size=(7, 9))
    z[1, 1] = np.nan
    grid = GridMeta(7, 9, 5.0, 2.0, 9.0, -2.0, 32633)
    out = tiles.export(cells_of(spark, z), grid, str(tmp_path), "hec_ras")
    back = geotiff.read_geotiff(spark, out["tif"])
    assert back.grid == grid
    got = {(r.r, r.c): r.z for r in back.cells().collect()}
    assert got[1, 1] is None and got[3, 4] == np.float32(z[3, 4])
