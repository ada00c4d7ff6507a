"""Rasters as arrays: whole rows of the grid (``RowArrays``), or a row of the table for each tile (``Blocks``).

Every cell of the grid exists in both; NaN or null is no data. ``map`` runs a kernel on tiles with a ring of neighbours:

* from RowArrays pieces of rows travel once, as arrays; only the ring's rows and columns travel twice;
* Blocks hold a tile's values as one binary column and its four rims as others. A kernel with a ring makes tiles send rims
  alone: those columns are read, cut and shuffled, and where the blocks are stored by bucket the tiles stay where they are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillwork.grid import DC, DR, GridMeta
from rillwork.plans.blocks import TILE, Block, arrow_schema, as_table, block_of, in_tiles
from rillwork.plans.store import shared_path

#: Width of the stored rims; kernels with wider rings read the tiles themselves to cut what they send.
RIM = 4
BLOCKS = "tr int, tc int, z binary, north binary, south binary, west binary, east binary"
STRIPS = "tr int, tc int, side int, strip binary"
Kernel = Callable[[Block], dict]


def _empty(side: int) -> np.ndarray:
    return np.full((side, side), np.nan)


def _tile_block(grid: GridMeta, tr: int, tc: int, tile: int, halo: int, name: str, z: np.ndarray) -> Block:
    r0, c0 = tr * tile, tc * tile
    r, c = np.ogrid[r0 - halo : r0 + tile + halo, c0 - halo : c0 + tile + halo]
    return Block({}, r0, c0, tile, halo, (r >= 0) & (r < grid.rows) & (c >= 0) & (c < grid.cols), {name: z})


def _tiles(grid: GridMeta, tile: int) -> tuple[int, int]:
    """The last tile's row and column."""
    return (grid.rows - 1) // tile, (grid.cols - 1) // tile


@dataclass(frozen=True)
class RowArrays:
    """rows(r, values: array of the grid's width), one for each row of the grid; a missing row is no data."""

    rows: DataFrame
    grid: GridMeta
    tile: int = TILE
    name: str = "z"

    def cells(self) -> DataFrame:
        value = F.posexplode("values").alias("c", self.name)
        return self.rows.select(F.col("r").cast("int").alias("r"), value).withColumn(self.name, F.col(self.name).cast("double"))

    def map(self, kernel: Kernel, schema: str, halo: int = 0) -> DataFrame:
        tile, grid, name, target = self.tile, self.grid, self.name, arrow_schema(schema)
        last_r, last_c = _tiles(grid, tile)
        at = lambda d: F.floor((F.col("r") + d) / tile).cast("int")
        rows = F.explode(F.sequence(F.greatest(at(-halo), F.lit(0)), F.least(at(halo), F.lit(last_r)))).alias("tr")
        sent = self.rows.select(F.col("r").cast("int").alias("r"), "values", rows)
        sent = sent.select("r", "values", "tr", F.explode(F.sequence(F.lit(0), F.lit(last_c))).alias("tc")) if last_c else sent.withColumn("tc", F.lit(0))
        first = F.greatest(F.col("tc") * tile - halo, F.lit(0))
        if last_c:
            sent = sent.withColumn("values", F.slice("values", first + 1, F.col("tc") * tile + tile + halo - first))

        def run(t: pa.Table) -> pa.Table:
            tr, tc, side = t.column("tr")[0].as_py(), t.column("tc")[0].as_py(), tile + 2 * halo
            z, lists = _empty(side), t.column("values").combine_chunks()
            r, widths = t.column("r").to_numpy() - (tr * tile - halo), lists.value_lengths().fill_null(0).to_numpy()
            flat = lists.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
            c = max(tc * tile - halo, 0) - (tc * tile - halo)
            place = np.arange(len(flat)) - np.repeat(np.cumsum(widths) - widths, widths)
            z[np.repeat(r, widths), place + c] = flat
            return as_table(kernel(_tile_block(grid, tr, tc, tile, halo, name, z)), target)

        return sent.groupBy("tr", "tc").applyInArrow(run, schema)

    def blocks(self) -> Blocks:
        name = self.name
        return Blocks(self.map(lambda b: _row_of(b, b.own(b.arrays[name])), BLOCKS), self.grid, self.tile, name)


def row_of_values(tr: int, tc: int, own: np.ndarray) -> dict:
    """The row of BLOCKS of a tile's own values."""
    own = np.ascontiguousarray(own, "<f8")
    rims = {"north": own[:RIM], "south": own[-RIM:], "west": own[:, :RIM], "east": own[:, -RIM:]}
    return {"tr": [tr], "tc": [tc], "z": [own.tobytes()]} | {k: [np.ascontiguousarray(v).tobytes()] for k, v in rims.items()}


def _row_of(block: Block, own: np.ndarray) -> dict:
    return row_of_values(block.r0 // block.tile, block.c0 // block.tile, own)


def blocks_of_cells(cells: DataFrame, grid: GridMeta, tile: int = TILE, name: str = "z") -> Blocks:
    """cells(r, c, name) packed into blocks, by one shuffle; places without a row are no data."""
    target = arrow_schema(BLOCKS)

    def run(t: pa.Table) -> pa.Table:
        b = block_of(t, tile, 0, (name,))
        return as_table(_row_of(b, b.own(b.arrays[name])), target)

    rows = in_tiles(cells.select("r", "c", name), grid, tile, 0).groupBy("tr", "tc").applyInArrow(run, BLOCKS)
    return Blocks(rows, grid, tile, name)


@dataclass(frozen=True)
class Blocks:
    """rows of BLOCKS, one for each tile; values are row by row as little-endian doubles, full squares also at the grid's far edges."""

    rows: DataFrame
    grid: GridMeta
    tile: int = TILE
    name: str = "z"

    def cells(self) -> DataFrame:
        name = self.name
        return self.map(lambda b: b.rows(b.own(b.have), **{name: b.own(b.arrays[name])}), f"r int, c int, {name} double")

    def stored(self) -> Blocks:
        """Written to the shared folder by bucket of (tr, tc), so that later joins on the tile leave it in place."""
        spark = self.rows.sparkSession
        n, name = int(spark.conf.get("spark.sql.shuffle.partitions")), f"rillwork_blocks_{uuid4().hex}"
        sorted_ = self.rows.repartition(n, "tr", "tc").sortWithinPartitions("tr", "tc")
        sorted_.write.bucketBy(n, "tr", "tc").sortBy("tr", "tc").option("path", shared_path(spark, "blocks")).format("parquet").saveAsTable(name)
        return replace(self, rows=spark.table(name))

    def strips(self, halo: int) -> DataFrame:
        """STRIPS: what the tiles send: for each neighbour the values next to it; ``side`` is the direction that they were sent in."""
        if halo > self.tile:
            raise ValueError("a ring is at most as wide as a tile")
        tile, (last_r, last_c), target = self.tile, _tiles(self.grid, self.tile), arrow_schema(STRIPS)
        narrow = halo <= RIM

        def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out: dict[str, list] = {f.name: [] for f in target}
                for row in range(batch.num_rows):
                    tr, tc = batch.column(0)[row].as_py(), batch.column(1)[row].as_py()
                    parts = [np.frombuffer(batch.column(i)[row].as_buffer(), "<f8") for i in range(2, batch.num_columns)]
                    north, south, west, east = (parts[0].reshape(RIM, tile), parts[1].reshape(RIM, tile), parts[2].reshape(tile, RIM), parts[3].reshape(tile, RIM)) if narrow else [parts[0].reshape(tile, tile)] * 4
                    for k, (dr, dc) in enumerate(zip(DR, DC, strict=True)):
                        if not (0 <= tr + dr <= last_r and 0 <= tc + dc <= last_c):
                            continue
                        part = north[:halo] if dr < 0 else south[-halo:] if dr > 0 else west if dc < 0 else east
                        part = part[:, :halo] if dc < 0 else part[:, -halo:] if dc > 0 else part
                        for name, v in zip(out, (tr + dr, tc + dc, k, np.ascontiguousarray(part).tobytes()), strict=True):
                            out[name].append(v)
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in target], schema=target)

        columns = ("north", "south", "west", "east") if narrow else ("z",)
        return self.rows.select("tr", "tc", *columns).mapInArrow(send, STRIPS)

    def map(self, kernel: Kernel, schema: str, halo: int = 0) -> DataFrame:
        tile, grid, name, target = self.tile, self.grid, self.name, arrow_schema(schema)
        own = self.rows.select("tr", "tc", "z")

        def block(tr: int, tc: int, z: pa.Scalar) -> Block:
            padded = _empty(tile + 2 * halo)
            padded[halo : halo + tile, halo : halo + tile] = np.frombuffer(z.as_buffer(), "<f8").reshape(tile, tile)
            return _tile_block(grid, tr, tc, tile, halo, name, padded)

        if not halo:

            def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    for row in range(batch.num_rows):
                        yield from as_table(kernel(block(batch.column(0)[row].as_py(), batch.column(1)[row].as_py(), batch.column(2)[row])), target).to_batches()

            return own.mapInArrow(each, schema)

        def met(t: pa.Table, strips: pa.Table) -> pa.Table:
            if not t.num_rows:
                return target.empty_table()
            b = block(t.column("tr")[0].as_py(), t.column("tc")[0].as_py(), t.column("z")[0])
            z, span = b.arrays[name], {-1: slice(halo + tile, None), 0: slice(halo, halo + tile), 1: slice(0, halo)}
            for k, strip in zip(strips.column("side").to_pylist(), strips.column("strip"), strict=True):
                part = z[span[DR[k]], span[DC[k]]]
                part[...] = np.frombuffer(strip.as_buffer(), "<f8").reshape(part.shape)
            return as_table(kernel(b), target)

        return own.groupBy("tr", "tc").cogroup(self.strips(halo).groupBy("tr", "tc")).applyInArrow(met, schema)

    def map_with(self, more: DataFrame, kernel: Callable[[Block, pa.Table], dict], schema: str) -> DataFrame:
        """As ``map`` without a ring; the kernel also gets the rows of ``more``(tr, tc, ...) that belong to the tile."""
        tile, grid, name, target = self.tile, self.grid, self.name, arrow_schema(schema)

        def met(t: pa.Table, rows: pa.Table) -> pa.Table:
            if not t.num_rows:
                return target.empty_table()
            z = np.frombuffer(t.column("z")[0].as_buffer(), "<f8").reshape(tile, tile)
            return as_table(kernel(_tile_block(grid, t.column("tr")[0].as_py(), t.column("tc")[0].as_py(), tile, 0, name, z), rows), target)

        return self.rows.select("tr", "tc", "z").groupBy("tr", "tc").cogroup(more.groupBy("tr", "tc")).applyInArrow(met, schema)


def read_blocks(spark: SparkSession, path: str, grid: GridMeta, tile: int = TILE, name: str = "z") -> Blocks:
    return Blocks(spark.read.parquet(path), grid, tile, name)


def write_blocks(blocks: Blocks, path: str) -> None:
    """Parquet sorted by tile, so that readers of some tiles skip the rest."""
    blocks.rows.repartitionByRange("tr", "tc").sortWithinPartitions("tr", "tc").write.parquet(path)


Arrays = RowArrays | Blocks


def to_blocks(arrays: Arrays, kernel: Callable[[Block], np.ndarray], halo: int = 0, name: str = "z") -> Blocks:
    """The blocks of a new raster, from a kernel that gives a tile's own values."""
    rows = arrays.map(lambda b: _row_of(b, np.where(b.own(b.have), kernel(b), np.nan)), BLOCKS, halo)
    return Blocks(rows, arrays.grid, arrays.tile, name)


def d8_blocks(arrays: Arrays) -> Blocks:
    """The code of the steepest drop of each cell, the lowest on ties; NaN where nothing lies lower."""
    name, steps = arrays.name, [arrays.grid.step(k) for k in range(8)]

    def kernel(b: Block) -> np.ndarray:
        a = b.arrays[name]
        drop = np.stack([(b.own(a) - b.shifted(a, DR[k], DC[k])) / steps[k] for k in range(8)])
        drop = np.where(np.isnan(drop), -np.inf, drop)
        return np.where(drop.max(axis=0) > 0, drop.argmax(axis=0).astype(float), np.nan)

    return to_blocks(arrays, kernel, 1, "dir")


def window3_arrays(arrays: Arrays, value: str = "z") -> DataFrame:
    """As ``stencil.window3``, by a tile kernel."""

    name = arrays.name

    def kernel(b: Block) -> dict:
        a = b.arrays[name]
        return b.rows(b.own(b.have), **{value: b.own(a)}, **{f"n{k}": b.shifted(a, DR[k], DC[k]) for k in range(8)})

    return arrays.map(kernel, f"r int, c int, {value} double, " + ", ".join(f"n{k} double" for k in range(8)), 1)


def summed(a: np.ndarray, window: int) -> np.ndarray:
    """The sums of the windows of a padded array that lie in it, by running sums in both directions: no cost by window."""
    for axis in (0, 1):
        run = np.cumsum(a, axis=axis)
        a = np.concatenate([np.take(run, [window - 1], axis), np.take(run, range(window, run.shape[axis]), axis) - np.take(run, range(run.shape[axis] - window), axis)], axis)
    return a


def reflected(block: Block, grid: GridMeta, a: np.ndarray) -> np.ndarray:
    """``a`` with its places beyond the grid's edges mirrored from inside."""

    def places(first: int, size: int, n: int) -> np.ndarray:
        at = np.arange(first, first + n)
        at = np.where(at < 0, -at - 1, np.where(at >= size, 2 * size - 1 - at, at))
        return np.clip(at - first, 0, n - 1)

    h = block.halo
    return a[places(block.r0 - h, grid.rows, a.shape[0])][:, places(block.c0 - h, grid.cols, a.shape[1])]


def focal_arrays(arrays: Arrays, window: int) -> DataFrame:
    """As ``stencil.focal`` with reflected edges. The window's half is at most a tile, and at most the grid's sides."""
    grid, name, back, ahead = arrays.grid, arrays.name, window // 2, window - window // 2 - 1

    def kernel(b: Block) -> dict:
        z = reflected(b, grid, b.arrays[name])
        if back != ahead:
            z = z[: z.shape[0] - 1, : z.shape[1] - 1]
        valid = ~np.isnan(z)
        filled = np.where(valid, z, 0.0)
        n = summed(valid.astype(float), window)
        with np.errstate(all="ignore"):
            # deviations from one value of the tile, so that squares stay small beside it
            base = filled[valid].mean() if valid.any() else 0.0
            off = np.where(valid, filled - base, 0.0)
            mean = summed(off, window) / n
            sd = np.sqrt(np.maximum(summed(off * off, window) / n - mean * mean, 0.0))
        return b.rows(b.own(b.have), z=b.own(b.arrays[name]), m=np.where(n > 0, mean + base, np.nan), sd=np.where(n > 0, sd, np.nan))

    return arrays.map(kernel, "r int, c int, z double, m double, sd double", back)


def fits_focal(arrays: Arrays, window: int) -> bool:
    return window // 2 <= min(arrays.tile, arrays.grid.rows, arrays.grid.cols)
