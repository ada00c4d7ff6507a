"""Operators without SQL against plain versions: relaxation, noise, LAS files, exports, flats."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from rillwork.grid import GridMeta
from rillwork.operators import conditioning, interpolate, streams, vectors
from rillwork.sources import las, tiles


def cells_of(spark, z):
    return spark.createDataFrame([(r, c, None if np.isnan(v) else float(v)) for (r, c), v in np.ndenumerate(z)], "r int, c int, z double")


def array_of(df, shape):
    out = np.full(shape, np.nan)
    for r, c, z in df.collect():
        out[r, c] = np.nan if z is None else z
    return out


@pytest.mark.parametrize("curved", [False, True])
def test_relaxation_equals_single_sweeps(spark, curved):
    rng = np.random.default_rng(3)
    z = np.where(rng.random((23, 17)) < 0.3, rng.random((23, 17)), np.nan)
    fixed, w, stopped = ~np.isnan(z), np.where(np.isnan(z), np.nanmean(z), z), False
    for _ in range(50):
        p = np.pad(w, 1, mode="edge")
        near = p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, 2:] + p[1:-1, :-2]
        u = np.pad(near - 4 * w, 1, mode="edge")
        bend = (u[:-2, 1:-1] + u[2:, 1:-1] + u[1:-1, 2:] + u[1:-1, :-2]) / 4 if curved else 0
        new = np.where(fixed, w, (near - bend) / 4)
        stopped, w = np.abs(new - w).max() < 1e-3, new
        if stopped:
            break
    got = interpolate.relax(cells_of(spark, z), GridMeta(23, 17), 50, 1e-3, curved, tile=8, sweeps=3)
    assert np.allclose(array_of(got, z.shape), w, atol=1e-9)


def test_relaxation_needs_data(spark):
    with pytest.raises(ValueError):
        interpolate.relax(cells_of(spark, np.full((3, 3), np.nan)), GridMeta(3, 3))


def test_noise_of_zero_is_plain_filling(spark):
    z = np.random.default_rng(5).random((12, 12))
    cells, grid = cells_of(spark, z), GridMeta(12, 12)
    share = array_of(conditioning.stochastic_depressions(cells, grid, 0.0, 3, tile=5), z.shape)
    raised = array_of(conditioning.fill_depressions(cells, grid, tile=5), z.shape) > z
    assert (share == raised).all()


def test_flats_drain_across_tiles(spark):
    z = np.full((9, 9), 5.0)
    z[4, 1:8] = z[5, 1:8] = 2.0
    z[4, 0] = 1.0
    one, many = (array_of(conditioning.resolve_flats(cells_of(spark, z), GridMeta(9, 9), 1e-3, tile=t), z.shape) for t in (64, 3))
    assert np.array_equal(one, many)
    assert (np.diff(one[4, 1:8]) > 0).all() and one[4, 1] == 2.0


def test_las_points(spark, tmp_path):
    header = bytearray(227)
    header[:4], header[24], header[25], header[104] = b"LASF", 1, 2, 0
    struct.pack_into("<I", header, 96, 227)
    struct.pack_into("<HI", header, 105, 20, 2)
    struct.pack_into("<6d", header, 131, 0.01, 0.01, 0.01, 100.0, 200.0, 0.0)
    records = b"".join(struct.pack("<iiiHBBbBH", *p) for p in [(1, 2, 3, 7, 0b001010, 2, 0, 0, 0), (100, 200, 300, 9, 1, 5, 0, 0, 0)])
    (tmp_path / "a.las").write_bytes(bytes(header) + records)
    rows = las.read_las(spark, str(tmp_path / "*.las")).orderBy("x").collect()
    assert [(round(r.x, 2), round(r.y, 2), round(r.z, 2), r.intensity, r.classification, r.return_number) for r in rows] == [(100.01, 200.02, 0.03, 7, 2, 2), (101.0, 202.0, 3.0, 9, 5, 1)]


def test_exports(spark):
    z = np.array([[1.5, np.nan], [3.0, 0.25]])
    rows = tiles.float_rows(cells_of(spark, z)).orderBy("r").collect()
    assert np.frombuffer(b"".join(bytes(r["content"]) for r in rows), "<f4").tolist() == [1.5, -9999.0, 3.0, 0.25]
    assert b"".join(bytes(r["mask"]) for r in rows) == b"\1\0\1\1"
    assert [r["line"] for r in tiles.ascii_rows(cells_of(spark, z)).orderBy("r").collect()] == ["1.500000 -9999.000000", "3.000000 0.250000"]
    pit = np.full((5, 5), 2.0)
    pit[2, 2] = 1.0
    with pytest.raises(ValueError):
        tiles.export_rows(cells_of(spark, pit), GridMeta(5, 5), "lisflood_fp")


def test_polygon_outside_of_the_grid_covers_nothing(spark):
    polygons = spark.createDataFrame([(1, [[(50.0, -50.0), (60.0, -50.0), (55.0, -60.0)]])], "id int, rings array<array<struct<x:double,y:double>>>")
    assert vectors.polygon_cells(polygons, GridMeta(10, 10)).count() == 0
    assert vectors.hydroflatten(cells_of(spark, np.ones((10, 10))), polygons, GridMeta(10, 10)).where(F.col("z") != 1).count() == 0


def test_order_by_name(spark):
    nodes = spark.createDataFrame([(0, 0, 0, 7, 4), (2, 0, 2, 1, 4), (4, 1, 1, None, None)], "node bigint, r int, c int, dir int, ptr bigint")
    for method in ("shreve", "strahler"):
        assert {row[-1] for row in streams.order(nodes, method).where("node = 4").collect()} == {2}
    with pytest.raises(ValueError):
        streams.order(nodes, "topological")
