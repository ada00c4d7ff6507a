"""Tile windows and rows of text and binary grid formats, in the order of the grid's rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillwork.grid import GridMeta

NO_DATA = -9999.0


def tile_windows(spark: SparkSession, grid: GridMeta, tile_rows: int = 1024, tile_cols: int = 1024, overlap: int = 0) -> DataFrame:
    """(row_off, col_off, n_rows, n_cols): windows that start a tile less the overlap apart and end at the grid's edges."""
    starts = lambda n, tile, name: spark.range(0, n, max(1, tile - overlap)).withColumnRenamed("id", name)
    columns = F.sequence(F.lit(0).cast("bigint"), F.lit(grid.cols - 1).cast("bigint"), F.lit(max(1, tile_cols - overlap)).cast("bigint"))
    windows = starts(grid.rows, tile_rows, "row_off").withColumn("col_off", F.explode(columns))
    return windows.select("row_off", "col_off", F.least(F.lit(tile_rows), grid.rows - F.col("row_off")).alias("n_rows"), F.least(F.lit(tile_cols), grid.cols - F.col("col_off")).alias("n_cols"))


def row_arrays(cells: DataFrame, no_data: float = NO_DATA) -> DataFrame:
    """(r, zs): the values of each grid row in order."""
    return cells.groupBy("r").agg(F.transform(F.array_sort(F.collect_list(F.struct("c", F.coalesce("z", F.lit(no_data)).alias("z")))), lambda s: s["z"]).alias("zs"))


def ascii_header(grid: GridMeta, no_data: float = NO_DATA) -> str:
    bottom = grid.y0 + grid.rows * grid.dy
    return f"ncols {grid.cols}\nnrows {grid.rows}\nxllcorner {grid.x0}\nyllcorner {bottom}\ncellsize {abs(grid.dx)}\nNODATA_value {no_data}\n"


def ascii_rows(cells: DataFrame, no_data: float = NO_DATA) -> DataFrame:
    """(r, line): values with six decimals, for Arc-ASCII grids; ``orderBy("r")`` and ``write.text`` give the file's parts."""
    return row_arrays(cells, no_data).select("r", F.array_join(F.transform("zs", lambda z: F.format_string("%.6f", z)), " ").alias("line"))


def float_rows(cells: DataFrame, no_data: float = NO_DATA) -> DataFrame:
    """(r, content, mask): values as little-endian 32-bit floats and 1 where there is data, for .flt, .dep and .msk grids."""

    def pack(frames):
        for pdf in frames:
            values = [np.asarray(z, "<f4") for z in pdf.zs]
            yield pd.DataFrame({"r": pdf.r, "content": [v.tobytes() for v in values], "mask": [(v != np.float32(no_data)).astype("u1").tobytes() for v in values]})

    return row_arrays(cells, no_data).mapInPandas(pack, "r int, content binary, mask binary")


def export_rows(cells: DataFrame, grid: GridMeta, target: str, validate: bool = True) -> DataFrame:
    """The rows of a target's grid file. lisflood_fp takes no grid with interior sinks, unless ``validate`` is off."""
    from rillwork.operators.terrain import local_minima

    if target in ("lisflood_fp", "iber"):
        if target == "lisflood_fp" and validate and not local_minima(cells, grid).isEmpty():
            raise ValueError("the grid has sinks; fill depressions first")
        return ascii_rows(cells)
    if target in ("tuflow", "sfincs"):
        return float_rows(cells)
    raise ValueError("target is one of lisflood_fp, iber, tuflow, sfincs")


def gmsh_script(grid: GridMeta) -> str:
    """The grid's bounds as a rectangle to mesh, with cells' size as the length of its elements."""
    x, y = (grid.x0, grid.x0 + grid.cols * grid.dx), (grid.y0 + grid.rows * grid.dy, grid.y0)
    corners = [(x[0], y[0]), (x[1], y[0]), (x[1], y[1]), (x[0], y[1])]
    lines = [f"cl = {abs(grid.dx)};", *(f"Point({i}) = {{{a}, {b}, 0, cl}};" for i, (a, b) in enumerate(corners, 1))]
    lines += [f"Line({i}) = {{{i}, {i % 4 + 1}}};" for i in range(1, 5)]
    return "\n".join([*lines, "Line Loop(1) = {1, 2, 3, 4};", "Plane Surface(1) = {1};"]) + "\n"


def header(grid: GridMeta, target: str, no_data: float = NO_DATA) -> str:
    """The text before (or, for tuflow, beside) the rows of a target's file; empty for sfincs."""
    text = ascii_header(grid, no_data)
    if target == "tuflow":
        return text + "byteorder LSBFIRST\n"
    if target == "iber":
        return "# Iber mesh boundary (auto-generated)\n" + text.upper().replace("NODATA_VALUE", "NODATA")
    return text if target == "lisflood_fp" else ""


def export(cells: DataFrame, grid: GridMeta, path: str, target: str, validate: bool = True) -> dict[str, str]:
    """Writes a target's files as folders of parts, to be read (or joined) in the order of their names; returns the folders.

    Headers are folders of their own, since a grid's rows are written by many tasks.
    """
    spark, out = cells.sparkSession, {}
    text = lambda name, content: spark.createDataFrame([(content.rstrip("\n"),)], "value string").coalesce(1).write.text(f"{path}/{name}") or f"{path}/{name}"
    if target == "hec_ras":
        from rillwork.plans.arrays import blocks_of_cells
        from rillwork.sources.geotiff import write_geotiff

        write_geotiff(blocks_of_cells(cells, grid), f"{path}/hec_ras.tif", bits=32)
        return {"tif": f"{path}/hec_ras.tif"}
    if target == "gmsh":
        return {"geo": text("geo", gmsh_script(grid))}
    rows = export_rows(cells, grid, target, validate)
    if head := header(grid, target):
        out["header"] = text("header", head)
    ordered = rows.repartitionByRange("r").sortWithinPartitions("r")
    if target in ("lisflood_fp", "iber"):
        ordered.select(F.col("line").alias("value")).write.text(f"{path}/rows")
        return out | {"rows": f"{path}/rows"}
    for name, column in {"tuflow": {"flt": "content"}, "sfincs": {"dep": "content", "msk": "mask"}}[target].items():
        write_parts(ordered.select(column), f"{path}/{name}")
        out[name] = f"{path}/{name}"
    return out


def write_parts(rows: DataFrame, path: str) -> None:
    """Writes the one binary column, one file a partition; a task that is repeated writes the same file again."""
    from pyspark import TaskContext

    def write(batches):
        import pyarrow as pa
        from pyarrow import fs

        system, folder = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))
        system.create_dir(folder, recursive=True)
        name = f"{folder}/part-{TaskContext.get().partitionId():06d}"
        done, attempt = 0, f"{name}.{TaskContext.get().taskAttemptId()}"
        with system.open_output_stream(attempt) as f:
            for batch in batches:
                for x in batch.column(0).to_pylist():
                    f.write(x)
                    done += len(x)
        system.move(attempt, name)
        yield pa.RecordBatch.from_arrays([pa.array([done], pa.int64())], names=["bytes"])

    rows.mapInArrow(write, "bytes bigint").agg(F.sum("bytes")).collect()
