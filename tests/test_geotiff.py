"""GeoTIFF files: written by many tasks and read back; hand-made files of other layouts; failures leave nothing."""

import os
import struct
import zlib

import numpy as np
import pytest

from rillwork.grid import GridMeta
from rillwork.operators import terrain
from rillwork.plans.arrays import RowArrays
from rillwork.sources import geotiff


def arrays_of(spark, z, grid, tile):
    rows = [(int(r), [None if np.isnan(v) else float(v) for v in row]) for r, row in enumerate(z)]
    return RowArrays(spark.createDataFrame(rows, "r int, values array<double>").repartition(4), grid, tile)


def matrix(arrays):
    z = np.full((arrays.grid.rows, arrays.grid.cols), np.nan)
    for r in arrays.cells().collect():
        z[r.r, r.c] = np.nan if r.z is None else r.z
    return z


@pytest.mark.parametrize(("shape", "bits"), [((70, 53), 64), ((70, 53), 32), ((9, 5), 64), ((16, 16), 64)])
def test_what_is_written_is_read(spark, tmp_path, shape, bits):
    z = np.random.default_rng(4).normal(size=shape)
    z[2, 3], z[8, :] = np.nan, np.nan
    grid, path = GridMeta(*shape, 500.0, 30.0, 7000.0, -30.0, 32632), str(tmp_path / "dem.tif")
    geotiff.write_geotiff(arrays_of(spark, z, grid, 16).blocks(), path, bits=bits)
    back = geotiff.read_geotiff(spark, path)
    assert back.grid == grid and back.tile == 16
    expected = z if bits == 64 else z.astype("f4").astype(float)
    assert np.array_equal(matrix(back), expected, equal_nan=True)
    assert os.listdir(tmp_path) == ["dem.tif"]


def test_overviews_are_means_of_the_level_below(spark, tmp_path):
    z = np.random.default_rng(5).normal(size=(37, 50))
    z[:2, :2], z[5, 5] = np.nan, np.nan
    grid, path = GridMeta(37, 50, 1.0, 2.0, 3.0, -2.0, 4326), str(tmp_path / "p.tif")
    geotiff.write_geotiff(arrays_of(spark, z, grid, 16).blocks(), path, overviews=2)
    for level in (1, 2):
        padded = np.full((-(-z.shape[0] // 2) * 2, -(-z.shape[1] // 2) * 2), np.nan)
        padded[: z.shape[0], : z.shape[1]] = z
        quads = padded.reshape(padded.shape[0] // 2, 2, -1, 2).swapaxes(1, 2).reshape(padded.shape[0] // 2, -1, 4)
        z = np.array([[np.nanmean(q) if (~np.isnan(q)).any() else np.nan for q in row] for row in quads])
        got = geotiff.read_geotiff(spark, path, level)
        assert np.allclose(matrix(got), z, equal_nan=True)
    with pytest.raises(ValueError):
        geotiff.read_geotiff(spark, path, 3)


def classic(order, z, dtype, rows_per_strip, compression, predictor, no_data):
    """A stripped classic TIFF, written plainly."""
    strips = [z[i : i + rows_per_strip].astype(dtype) for i in range(0, len(z), rows_per_strip)]
    if predictor == 2:
        strips = [np.diff(s, axis=1, prepend=s[:, :1] * 0).astype(dtype) for s in strips]
    data = [s.astype(np.dtype(dtype).newbyteorder(order)).tobytes() for s in strips]
    data = [zlib.compress(d) if compression == 8 else d for d in data]
    n = len(data)
    at = [8 + sum(map(len, data[:i])) for i in range(n)]
    tail = 8 + sum(map(len, data))
    extra = struct.pack(f"{order}{n}I", *at) + struct.pack(f"{order}{n}I", *map(len, data)) + no_data
    kind = {"u": 1, "i": 2, "f": 3}[np.dtype(dtype).kind]
    inline = lambda v: struct.pack(f"{order}I", v)
    small = lambda v: struct.pack(f"{order}HH", v, 0)
    entries = [(256, 4, 1, inline(z.shape[1])), (257, 4, 1, inline(z.shape[0])), (258, 3, 1, small(np.dtype(dtype).itemsize * 8)), (259, 3, 1, small(compression)), (262, 3, 1, small(1)), (273, 4, n, inline(tail)), (277, 3, 1, small(1)), (278, 4, 1, inline(rows_per_strip)), (279, 4, n, inline(tail + 4 * n)), (317, 3, 1, small(predictor)), (339, 3, 1, small(kind)), (42113, 2, len(no_data), inline(tail + 8 * n))]
    ifd = tail + len(extra)
    body = struct.pack(f"{order}H", len(entries)) + b"".join(struct.pack(f"{order}HHI", t, k, c) + v for t, k, c, v in entries) + struct.pack(f"{order}I", 0)
    return (b"II" if order == "<" else b"MM") + struct.pack(f"{order}HI", 42, ifd) + b"".join(data) + extra + body


@pytest.mark.parametrize(("order", "dtype", "compression", "predictor"), [("<", "i2", 1, 1), (">", "i2", 8, 2), (">", "f4", 8, 1), ("<", "u1", 8, 2)])
def test_stripped_files_of_others(spark, tmp_path, order, dtype, compression, predictor):
    z = np.random.default_rng(6).integers(0, 90, (11, 7)).astype(float)
    z[3, 3] = 99
    path = tmp_path / "x.tif"
    path.write_bytes(classic(order, z, dtype, 4, compression, predictor, b"99.00\0"))
    z[3, 3] = np.nan
    assert np.array_equal(matrix(geotiff.read_geotiff(spark, str(path))), z, equal_nan=True)


def test_operators_work_on_what_is_read(spark, tmp_path):
    z = np.random.default_rng(7).normal(size=(40, 33))
    grid, path = GridMeta(40, 33), str(tmp_path / "d.tif")
    rows = arrays_of(spark, z, grid, 16)
    geotiff.write_geotiff(rows.blocks(), path)
    key = lambda df: sorted((r.r, r.c, round(r.slope, 9)) for r in df.collect() if r.slope is not None)
    assert key(terrain.slope(geotiff.read_geotiff(spark, path), grid)) == key(terrain.slope(rows.cells(), grid))


def test_failures_leave_no_file(spark, tmp_path, monkeypatch):
    rows = arrays_of(spark, np.zeros((20, 20)), GridMeta(20, 20), 16)
    monkeypatch.setattr(geotiff.os, "replace", lambda *_: (_ for _ in ()).throw(OSError("no")))
    with pytest.raises(OSError):
        geotiff.write_geotiff(rows.blocks(), str(tmp_path / "d.tif"))
    assert os.listdir(tmp_path) == []
    with pytest.raises(ValueError):
        geotiff.write_geotiff(rows.blocks(), "s3://bucket/x.tif")
    (tmp_path / "no.tif").write_bytes(b"PNG" * 9)
    with pytest.raises(ValueError):
        geotiff.read_geotiff(spark, str(tmp_path / "no.tif"))
