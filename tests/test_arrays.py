"""Rasters of arrays against cell relations: same windows, sums, directions, accumulation; what is shuffled."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rillwork.grid import GridMeta
from rillwork.operators import routing, terrain
from rillwork.plans import doubling
from rillwork.plans.arrays import RowArrays, blocks_of_cells, d8_blocks, focal_arrays, read_blocks, summed, to_blocks, window3_arrays, write_blocks
from rillwork.plans.doubling import downstream, upstream_length, upstream_sum
from rillwork.plans.stencil import focal, window3


@pytest.fixture(scope="module")
def raster():
    z = np.random.default_rng(3).normal(size=(23, 18))
    z[4, 5:9], z[0, 0], z[22, 17] = np.nan, np.nan, np.nan
    return z


def cells_of(spark, z):
    rows = [(int(r), int(c), None if np.isnan(v) else float(v)) for (r, c), v in np.ndenumerate(z)]
    return spark.createDataFrame(rows, "r int, c int, z double")


def arrays_of(spark, z, grid, tile):
    rows = [(int(r), [None if np.isnan(v) else float(v) for v in row]) for r, row in enumerate(z)]
    return RowArrays(spark.createDataFrame(rows, "r int, values array<double>"), grid, tile)


def table(df):
    out = {(r.r, r.c): tuple(v for k, v in r.asDict().items() if k not in "rc") for r in df.collect()}
    return {k: tuple(None if v is None else round(v, 6) for v in vs) for k, vs in sorted(out.items())}


def forms(spark, z, grid, tile):
    """The same raster as row arrays, as blocks of them, as blocks of cells, and stored by bucket."""
    rows = arrays_of(spark, z, grid, tile)
    return [rows, rows.blocks(), blocks_of_cells(cells_of(spark, z), grid, tile), rows.blocks().stored()]


@pytest.mark.parametrize("tile", [5, 8, 64])
def test_windows_equal_the_gather(spark, raster, tile):
    grid = GridMeta(*raster.shape)
    expected = table(window3(cells_of(spark, raster)))
    for form in forms(spark, raster, grid, tile):
        assert table(window3_arrays(form)) == expected
        assert table(form.cells()) == table(cells_of(spark, raster))


@pytest.mark.parametrize("window", [1, 2, 3, 6, 9])
def test_focal_equals_the_gather(spark, raster, window):
    """The widest ring is wider than the stored rims."""
    grid = GridMeta(*raster.shape)
    expected = table(focal(cells_of(spark, raster), grid, window))
    rows, _, _, stored = forms(spark, raster, grid, 7)
    assert table(focal_arrays(rows, window)) == expected and table(focal_arrays(stored, window)) == expected


def test_a_window_wider_than_tiles_takes_the_gather(spark, raster):
    grid = GridMeta(*raster.shape)
    assert table(terrain.tpi(arrays_of(spark, raster, grid, 4), grid, 13)) == table(terrain.tpi(cells_of(spark, raster), grid, 13))


@pytest.mark.parametrize("window", [1, 2, 5])
def test_running_sums(window):
    a = np.random.default_rng(1).integers(0, 9, (9, 7)).astype(float)
    plain = [[a[i : i + window, j : j + window].sum() for j in range(7 - window + 1)] for i in range(9 - window + 1)]
    assert np.array_equal(summed(a, window), plain)


def test_directions_and_accumulation(spark, raster):
    grid = GridMeta(*raster.shape, dx=2.0)
    for z in (raster, np.zeros((9, 9)), np.round(raster)):
        g = GridMeta(*z.shape, dx=2.0)
        expected = routing.flow_direction_d8(cells_of(spark, z), g)
        for form in forms(spark, z, g, 6)[::3]:
            d8 = d8_blocks(form)
            assert table(d8.cells()) == table(expected)
            assert table(routing.accumulate(d8.stored(), g)) == table(routing.accumulate(expected, g))
    assert grid.step(1) > 2


def test_blocks_with_circles_fall_back_to_cells(spark):
    dirs = np.full((6, 7), np.nan)
    dirs[2, 2], dirs[2, 3], dirs[0, 0], dirs[2, 1] = 6, 2, 0, 6
    dirs[3, 2], dirs[3, 3] = 4, 4
    grid = GridMeta(6, 7)
    cells = cells_of(spark, dirs).withColumnRenamed("z", "dir")
    blocks = blocks_of_cells(cells, grid, 3, "dir").stored()
    assert table(routing.accumulate(blocks, grid)) == table(routing.accumulate(cells, grid))


def test_only_rims_are_shuffled(spark, raster):
    stored = arrays_of(spark, raster, GridMeta(*raster.shape), 8).blocks().stored()
    plan = window3_arrays(stored)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan
    scans = [line for line in plan.splitlines() if "FileScan" in line and "north" in line]
    assert scans and all("z#" not in line.split("[")[1].split("]")[0] for line in scans)


def test_blocks_are_read_back(spark, raster, tmp_path):
    grid = GridMeta(*raster.shape)
    doubled = to_blocks(arrays_of(spark, raster, grid, 8), lambda b: 2 * b.own(b.arrays["z"]))
    write_blocks(doubled, str(tmp_path / "b"))
    assert table(read_blocks(spark, str(tmp_path / "b"), grid, 8).cells()) == table(cells_of(spark, 2 * raster))


def test_missing_and_short_rows_are_no_data(spark):
    rows = spark.createDataFrame([(0, [1.0, 2.0, 3.0]), (2, [4.0]), (3, None)], "r int, values array<double>")
    got = table(RowArrays(rows, GridMeta(4, 3), 2).blocks().cells())
    assert {k: v[0] for k, v in got.items() if v[0] is not None} == {(0, 0): 1.0, (0, 1): 2.0, (0, 2): 3.0, (2, 0): 4.0} and len(got) == 12


def test_small_forests_equal_rounds(spark, monkeypatch):
    rng = np.random.default_rng(8)
    rows = [(i * 7, int(rng.integers(0, i)) * 7 if i and rng.random() > 0.1 else None, float(i % 5), float(i % 3 + 1), int(i) if i % 4 == 0 else None) for i in range(300)] + [(5000, 9999, 1.0, 1.0, None)]
    nodes = spark.createDataFrame(rows, "node long, ptr long, w double, d double, v long")
    ways = (
        lambda: upstream_sum(nodes),
        lambda: upstream_length(nodes),
        lambda: downstream(nodes, {"v": lambda a, b: F.coalesce(a, b)}, {"v": lambda a, b: b if a is None else a}).select("node", "v"),
    )
    small = [sorted(map(tuple, f().collect())) for f in ways]
    monkeypatch.setattr(doubling, "SMALL", 0)
    assert small == [sorted(map(tuple, f().collect())) for f in ways]
    monkeypatch.undo()
    loop = spark.createDataFrame([(1, 2, 1.0), (2, 1, 1.0), (3, 1, 1.0)], "node long, ptr long, w double")
    with pytest.raises(doubling.Cycle):
        upstream_sum(loop)
