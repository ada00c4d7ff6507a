"""Rasters as tiles of arrays: a tile's cells and the ring around it come together in one shuffle.

Only ring cells are sent twice, so a tile kernel moves about one row a cell where a neighbour gather
moves nine. A kernel sees numpy arrays and returns columns.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillwork.grid import DC, DR, GridMeta

#: Side of a tile where an operator has no reason for another.
TILE = 256


@dataclass
class Block:
    """One tile with its ring of ``halo`` cells: ``r0``, ``c0`` are the tile's first own cell, ``have`` marks cells that are rows."""

    keys: dict
    r0: int
    c0: int
    tile: int
    halo: int
    have: np.ndarray
    arrays: dict[str, np.ndarray]

    def own(self, a: np.ndarray) -> np.ndarray:
        h, t = self.halo, self.tile
        return a[h : h + t, h : h + t]

    def shifted(self, a: np.ndarray, dr: int, dc: int) -> np.ndarray:
        """The values ``dr`` rows and ``dc`` columns from each own cell; both at most the halo."""
        h, t = self.halo, self.tile
        return a[h + dr : h + dr + t, h + dc : h + dc + t]

    def rows(self, where: np.ndarray, **columns: np.ndarray) -> dict:
        """Own cells that ``where`` marks as columns r, c and the given arrays of own cells; NaN becomes null."""
        r, c = np.nonzero(where)
        out = {"r": r + self.r0, "c": c + self.c0}
        for name, a in columns.items():
            v = a[r, c]
            out[name] = pa.array(v, mask=np.isnan(v)) if v.dtype.kind == "f" else pa.array(v)
        return out


def tiles_of(tile: int, halo: int) -> Column:
    """The tiles that a cell belongs to or borders on."""
    span = lambda x: F.sequence(F.floor((F.col(x) - halo) / tile).cast("int"), F.floor((F.col(x) + halo) / tile).cast("int"))
    return F.flatten(F.transform(span("r"), lambda i: F.transform(span("c"), lambda j: F.struct(i.alias("tr"), j.alias("tc")))))


def in_tiles(cells: DataFrame, grid: GridMeta, tile: int, halo: int) -> DataFrame:
    """cells with tr and tc, once for each tile that sees the cell; tiles outside of the grid are left out."""
    sent = cells.withColumn("__t", F.explode(tiles_of(tile, halo)) if halo else F.struct(F.floor(F.col("r") / tile).cast("int").alias("tr"), F.floor(F.col("c") / tile).cast("int").alias("tc")))
    sent = sent.withColumn("tr", F.col("__t.tr")).withColumn("tc", F.col("__t.tc")).drop("__t")
    if not halo:
        return sent
    return sent.where(F.col("tr").between(0, (grid.rows - 1) // tile) & F.col("tc").between(0, (grid.cols - 1) // tile))


def block_of(table: pa.Table, tile: int, halo: int, columns: tuple[str, ...], keys: tuple[str, ...] = ()) -> Block:
    tr, tc = table.column("tr")[0].as_py(), table.column("tc")[0].as_py()
    r0, c0, side = tr * tile, tc * tile, tile + 2 * halo
    at = (table.column("r").to_numpy() - (r0 - halo)) * side + table.column("c").to_numpy() - (c0 - halo)
    have = np.zeros(side * side, bool)
    have[at] = True
    arrays = {}
    for name in columns:
        a = np.full(side * side, np.nan)
        a[at] = table.column(name).cast(pa.float64()).to_numpy(zero_copy_only=False)
        arrays[name] = a.reshape(side, side)
    return Block({k: table.column(k)[0].as_py() for k in keys}, r0, c0, tile, halo, have.reshape(side, side), arrays)


def as_table(out: dict, target: pa.Schema) -> pa.Table:
    arrays = []
    for f in target:
        v = out[f.name]
        arrays.append(v.cast(f.type) if isinstance(v, pa.Array) else pa.array(v, type=f.type, from_pandas=True))
    return pa.Table.from_arrays(arrays, schema=target)


def arrow_schema(schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


def tile_map(cells: DataFrame, grid: GridMeta, kernel: Callable[[Block], dict], schema: str, tile: int = TILE, halo: int = 0, columns: tuple[str, ...] = ("z",), keys: tuple[str, ...] = ()) -> DataFrame:
    """cells(keys, r, c, columns) -> rows of ``schema``, made by ``kernel`` from each tile (and value of the keys).

    A raster of arrays (``plans.arrays``) of that one column maps its own tiles.
    """
    if not isinstance(cells, DataFrame):
        if keys or tuple(columns) != (cells.name,):
            raise ValueError("arrays have one column and no keys")
        return cells.map(kernel, schema, halo)
    target = arrow_schema(schema)
    sent = in_tiles(cells.select(*keys, "r", "c", *columns), grid, tile, halo)
    return sent.groupBy(*keys, "tr", "tc").applyInArrow(lambda t: as_table(kernel(block_of(t, tile, halo, columns, keys)), target), schema)


def tile_map_with(
    cells: DataFrame, more: DataFrame, grid: GridMeta, kernel: Callable[[Block, pa.Table], dict], schema: str, tile: int = TILE, halo: int = 0, columns: tuple[str, ...] = ("z",), keys: tuple[str, ...] = ()
) -> DataFrame:
    """As ``tile_map``; the kernel also gets the rows of ``more``(keys, tr, tc, ...) that belong to the tile."""
    if not isinstance(cells, DataFrame):
        if keys or halo or tuple(columns) != (cells.name,):
            raise ValueError("arrays have one column, no keys, and here no ring")
        return cells.map_with(more, kernel, schema)
    target = arrow_schema(schema)

    def run(t: pa.Table, m: pa.Table) -> pa.Table:
        if not t.num_rows:
            return target.empty_table()
        return as_table(kernel(block_of(t, tile, halo, columns, keys), m), target)

    sent = in_tiles(cells.select(*keys, "r", "c", *columns), grid, tile, halo)
    return sent.groupBy(*keys, "tr", "tc").cogroup(more.groupBy(*keys, "tr", "tc")).applyInArrow(run, schema)


def steps(connectivity: int = 8) -> list[tuple[int, int, int]]:
    """(code, row step, column step) of the neighbours."""
    return [(k, dr, dc) for k, (dr, dc) in enumerate(zip(DR, DC, strict=True)) if k % 2 == 0 or connectivity == 8]
