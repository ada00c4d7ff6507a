"""Tiled GeoTIFF files as rasters of blocks, and blocks as one tiled GeoTIFF with overviews.

Writing: tiles are compressed where they are and written as a table; their places in the file are prefix sums of their
sizes (by tile row, then within it); then each task writes its tiles and their directory entries straight into the file,
which takes its name only when all are done. So no task and not the driver holds more than its own tiles. The folder must
be one that all executors mount, since object stores do not take writes within a file.

Reading: the driver reads the directory's fixed part; tasks read ranges of tiles and the entries that place them.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rillwork.grid import GridMeta
from rillwork.plans.arrays import BLOCKS, Blocks, RowArrays, row_of_values
from rillwork.plans.blocks import arrow_schema, as_table
from rillwork.plans.store import settle
from rillwork.sources.las import _open

# Tags of the public TIFF and GeoTIFF formats.
WIDTH, LENGTH, BITS, COMPRESSION, PHOTOMETRIC, STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_COUNTS = 256, 257, 258, 259, 262, 273, 277, 278, 279
PREDICTOR, TILE_WIDTH, TILE_LENGTH, TILE_OFFSETS, TILE_COUNTS, FORMAT, SUBFILE = 317, 322, 323, 324, 325, 339, 254
PIXEL_SCALE, TIEPOINT, GEO_KEYS, NO_DATA = 33550, 33922, 34735, 42113
# GeoTIFF keys of the model, the raster's type, geographic and projected systems.
MODEL, RASTER, GEOGRAPHIC, PROJECTED = 1024, 1025, 2048, 3072
# TIFF's field types as struct codes, and its sample formats as numpy kinds.
FIELDS = {1: "B", 2: "s", 3: "H", 4: "I", 6: "b", 7: "s", 8: "h", 9: "i", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}
KINDS = {1: "u", 2: "i", 3: "f"}
#: Tiles that a row of reading work holds.
TILES_A_RANGE = 256


def _directory(grid: GridMeta, shape: tuple[int, int], tile: int, bits: int, overview: bool) -> list[tuple[int, int, list]]:
    """(tag, type, values) of a level, without the tiles' places."""
    rows, cols = shape
    sx, sy = grid.dx * grid.cols / cols, -grid.dy * grid.rows / rows
    geographic = 4000 <= grid.epsg < 5000
    keys = [1, 1, 0, 3, MODEL, 0, 1, 2 if geographic else 1, RASTER, 0, 1, 1, GEOGRAPHIC if geographic else PROJECTED, 0, 1, grid.epsg]
    entries = [
        (SUBFILE, 4, [1 if overview else 0]), (WIDTH, 4, [cols]), (LENGTH, 4, [rows]), (BITS, 3, [bits]), (COMPRESSION, 3, [8]), (PHOTOMETRIC, 3, [1]),
        (SAMPLES, 3, [1]), (TILE_WIDTH, 4, [tile]), (TILE_LENGTH, 4, [tile]), (FORMAT, 3, [3]), (NO_DATA, 2, [b"nan\0"]),
        (PIXEL_SCALE, 12, [sx, sy, 0.0]), (TIEPOINT, 12, [0.0, 0.0, 0.0, grid.x0, grid.y0, 0.0]), (GEO_KEYS, 3, keys),
    ]
    return entries


def _packed(kind: int, values: list) -> bytes:
    return values[0] if kind == 2 else struct.pack(f"<{len(values)}{FIELDS[kind]}", *values)


@dataclass(frozen=True)
class _Level:
    rows: int
    cols: int
    offsets_at: int
    counts_at: int


def _head(grid: GridMeta, shapes: list[tuple[int, int]], tile: int, bits: int) -> tuple[bytes, list[_Level], int]:
    """The file's head with all directories, where each level's tile entries begin, and where data begin."""
    counts = [-(-r // tile) * -(-c // tile) for r, c in shapes]
    plans = [_directory(grid, s, tile, bits, i > 0) for i, s in enumerate(shapes)]
    sizes = [8 + 20 * (len(p) + 2) + 8 for p in plans]
    long = [[len(_packed(k, v)) for _, k, v in p] for p in plans]
    starts, at = [], 16
    for size, lengths in zip(sizes, long, strict=True):
        starts.append(at)
        at += size + sum(-(-n // 8) * 8 for n in lengths if n > 8)
    levels = []
    for (r, c), n in zip(shapes, counts, strict=True):
        levels.append(_Level(r, c, at, at + 8 * n))
        at += 16 * n
    out = bytearray(struct.pack("<2sHHHQ", b"II", 43, 8, 0, starts[0]))
    for i, (plan, n, level) in enumerate(zip(plans, counts, levels, strict=True)):
        beyond, extra = starts[i] + sizes[i], bytearray()
        # one tile's place stands in the entry itself, which is then where tasks write it
        places = [(TILE_OFFSETS, 16, n, level.offsets_at), (TILE_COUNTS, 16, n, level.counts_at)]
        body, inline = [], {}
        for tag, kind, values in plan:
            data = _packed(kind, values)
            count = len(data) if kind == 2 else len(values)
            if len(data) > 8:
                field = struct.pack("<Q", beyond + len(extra))
                extra += data + b"\0" * (-len(data) % 8)
            else:
                field = data.ljust(8, b"\0")
            body.append((tag, struct.pack("<HHQ", tag, kind, count) + field))
        for tag, kind, count, where in places:
            body.append((tag, struct.pack("<HHQ", tag, kind, count) + struct.pack("<Q", where if count > 1 else 0)))
        body.sort()
        if n == 1:
            inline = {tag: starts[i] + 8 + 20 * j + 12 for j, (tag, _) in enumerate(body)}
            levels[i] = _Level(level.rows, level.cols, inline[TILE_OFFSETS], inline[TILE_COUNTS])
        out += struct.pack("<Q", len(body)) + b"".join(x for _, x in body) + struct.pack("<Q", starts[i + 1] if i + 1 < len(plans) else 0) + extra
    return bytes(out), levels, at


def halved(blocks: Blocks) -> Blocks:
    """The raster at half the resolution: the mean of the data of each two by two cells; a quarter of each tile travels."""
    grid, tile = blocks.grid, blocks.tile
    small = GridMeta(-(-grid.rows // 2), -(-grid.cols // 2), grid.x0, grid.dx * 2, grid.y0, grid.dy * 2, grid.epsg)
    half, name = tile // 2, blocks.name

    def quarter(b) -> dict:
        z = b.own(b.arrays[name]).reshape(half, 2, half, 2)
        n = (~np.isnan(z)).sum(axis=(1, 3))
        mean = np.where(n > 0, np.nansum(z, axis=(1, 3)) / np.maximum(n, 1), np.nan)
        return {"tr": [b.r0 // tile // 2], "tc": [b.c0 // tile // 2], "part": [b.r0 // tile % 2 * 2 + b.c0 // tile % 2], "z": [mean.astype("<f8").tobytes()]}

    target = arrow_schema(BLOCKS)

    def joined(t: pa.Table) -> pa.Table:
        z = np.full((tile, tile), np.nan)
        for part, data in zip(t.column("part").to_pylist(), t.column("z").to_pylist(), strict=True):
            r, c = part // 2 * half, part % 2 * half
            z[r : r + half, c : c + half] = np.frombuffer(data, "<f8").reshape(half, half)
        return as_table(row_of_values(t.column("tr")[0].as_py(), t.column("tc")[0].as_py(), z), target)

    quarters = blocks.map(quarter, "tr int, tc int, part int, z binary")
    return Blocks(quarters.groupBy("tr", "tc").applyInArrow(joined, BLOCKS), small, tile, name)


def write_geotiff(blocks: Blocks, path: str, overviews: int = 0, bits: int = 64) -> None:
    """Blocks as a tiled, deflated BigTIFF of floating-point cells (``bits`` 32 or 64) with ``overviews`` coarser levels.

    No data is NaN. Cells keep their place by the grid's origin, cell size and EPSG code. Tiles are squares of a multiple of 16.
    """
    if "://" in path and not path.startswith("file:"):
        raise ValueError("one file is written in place, so its folder must be mounted by all executors")
    if bits not in (32, 64) or blocks.tile % 16:
        raise ValueError("cells have 32 or 64 bits, and a tile's side is a multiple of 16")
    name, tile, grid = path.removeprefix("file:"), blocks.tile, blocks.grid
    pyramid = [Blocks(settle(blocks.rows, "level"), grid, tile, blocks.name)]
    for _ in range(overviews):
        coarser = halved(pyramid[-1])
        pyramid.append(Blocks(settle(coarser.rows, "level"), coarser.grid, tile, blocks.name))
    shapes = [(b.grid.rows, b.grid.cols) for b in pyramid]
    head, levels, begin = _head(grid, shapes, tile, bits)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                z = np.frombuffer(batch.column(2)[row].as_buffer(), "<f8").astype(f"<f{bits // 8}")
                data = zlib.compress(z.tobytes(), 6)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, 1), batch.column(1).slice(row, 1), pa.array([len(data)], pa.int64()), pa.array([data], pa.binary())], names=["tr", "tc", "size", "data"])

    parts = [b.rows.select("tr", "tc", "z").mapInArrow(pack, "tr int, tc int, size bigint, data binary").select(F.lit(i).alias("level"), "*") for i, b in enumerate(pyramid)]
    tiles = parts[0]
    for part in parts[1:]:
        tiles = tiles.unionByName(part)
    tiles = settle(tiles.repartitionByRange("level", "tr", "tc").sortWithinPartitions("level", "tr", "tc"), "tiff-tiles")
    # a row of tiles is one row here, so the second window is over few rows
    within = Window.partitionBy("level", "tr").orderBy("tc").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.orderBy("level", "tr").rowsBetween(Window.unboundedPreceding, -1)
    sums = tiles.groupBy("level", "tr").agg(F.sum("size").alias("size"))
    sums = sums.select("level", "tr", (F.coalesce(F.sum("size").over(before), F.lit(0)) + begin).alias("base"))
    inside = tiles.select("level", "tr", "tc", F.coalesce(F.sum("size").over(within), F.lit(0)).alias("shift"))
    places = settle(inside.join(sums, ["level", "tr"]).select("level", "tr", "tc", (F.col("base") + F.col("shift")).alias("at")), "tiff-places")
    draft = f"{name}.{uuid4().hex}"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = 0
        with open(draft, "r+b") as f:
            for batch in batches:
                for level, tr, tc, at, data in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                    place = levels[level]
                    i = tr * -(-place.cols // tile) + tc
                    for where, content in ((at, data), (place.offsets_at + 8 * i, struct.pack("<Q", at)), (place.counts_at + 8 * i, struct.pack("<Q", len(data)))):
                        f.seek(where)
                        f.write(content)
                    done += 1
        yield pa.RecordBatch.from_arrays([pa.array([done], pa.int64())], names=["tiles"])

    os.makedirs(os.path.dirname(draft) or ".", exist_ok=True)
    try:
        with open(draft, "wb") as f:
            f.write(head)
            f.truncate(begin)
        placed = tiles.join(places, ["level", "tr", "tc"]).select("level", "tr", "tc", "at", "data")
        placed.mapInArrow(write, "tiles bigint").agg(F.sum("tiles")).collect()
        os.replace(draft, name)
    finally:
        if os.path.exists(draft):
            os.remove(draft)


def _fields(path: str, level: int) -> tuple[str, dict[int, tuple[int, int, int]], dict[int, list]]:
    """Byte order; of each tag its type, count and place; and the values of tags that are not the tiles' own lists."""
    with _open(path) as f:
        start = f.read(16)
        order = {b"II": "<", b"MM": ">"}.get(start[:2])
        if order is None or (magic := struct.unpack_from(f"{order}H", start, 2)[0]) not in (42, 43):
            raise ValueError("not a TIFF file")
        big = magic == 43
        at = struct.unpack_from(f"{order}Q", start, 8)[0] if big else struct.unpack_from(f"{order}I", start, 4)[0]
        word, entry = ("Q", 20) if big else ("I", 12)
        for step in range(level + 1):
            if not at:
                raise ValueError("the file has no such level")
            f.seek(at)
            (n,) = struct.unpack(f"{order}{'Q' if big else 'H'}", f.read(8 if big else 2))
            body = f.read(n * entry)
            (following,) = struct.unpack(f"{order}{word}", f.read(8 if big else 4))
            first, at = at + (8 if big else 2), following if step < level else at
        tags, values = {}, {}
        for i in range(n):
            tag, kind, count = struct.unpack_from(f"{order}HH{word}", body, i * entry)
            size = count * struct.calcsize(FIELDS.get(kind, "B"))
            inside = i * entry + entry - (8 if big else 4)
            where = first + inside if size <= (8 if big else 4) else struct.unpack_from(f"{order}{word}", body, inside)[0]
            tags[tag] = (kind, count, where)
            if tag not in (TILE_OFFSETS, TILE_COUNTS, STRIP_OFFSETS, STRIP_COUNTS) and kind in FIELDS:
                f.seek(where)
                data = f.read(size)
                values[tag] = [data] if FIELDS[kind] == "s" else list(struct.unpack(f"{order}{count}{FIELDS[kind]}", data))
    return order, tags, values


def _grid(values: dict[int, list], shape: tuple[int, int]) -> GridMeta:
    sx, sy = values.get(PIXEL_SCALE, [1.0, 1.0])[:2]
    col, row, _, x, y = values.get(TIEPOINT, [0.0] * 6)[:5]
    keys = values.get(GEO_KEYS, [])
    named = {keys[i]: keys[i + 3] for i in range(4, len(keys), 4) if keys[i + 1] == 0}
    return GridMeta(*shape, x - col * sx, sx, y + row * sy, -sy, int(named.get(PROJECTED, named.get(GEOGRAPHIC, 4326))))


def read_geotiff(spark: SparkSession, path: str, level: int = 0, name: str = "z") -> Blocks | RowArrays:
    """A one-band GeoTIFF: blocks of its square tiles, or row arrays of its strips; ``level`` 0 is the finest.

    Classic and big files of either byte order, whole or floating-point cells, stored plain or deflated, with or without
    differences along rows (predictor 2, whole cells). Cells that equal the no-data value, and tiles left out, have no data.
    """
    order, tags, values = _fields(path, level)
    one = lambda tag, default: values.get(tag, [default])[0]
    rows, cols, compression, predictor = one(LENGTH, 0), one(WIDTH, 0), one(COMPRESSION, 1), one(PREDICTOR, 1)
    dtype = np.dtype(f"{order}{KINDS.get(one(FORMAT, 1), 'u')}{one(BITS, 8) // 8}")
    if one(SAMPLES, 1) != 1 or compression not in (1, 8, 32946) or predictor not in (1, 2) or predictor == 2 and dtype.kind == "f":
        raise ValueError("read are one band, plain or deflated, with predictor 1, or 2 for whole cells")
    tiled = TILE_WIDTH in tags
    wide, high = (one(TILE_WIDTH, 0), one(TILE_LENGTH, 0)) if tiled else (cols, min(one(ROWS_PER_STRIP, rows), rows))
    if tiled and wide != high:
        raise ValueError("tiles are squares")
    lists = [tags[TILE_OFFSETS if tiled else STRIP_OFFSETS], tags[TILE_COUNTS if tiled else STRIP_COUNTS]]
    across = -(-cols // wide)
    total, no_data = -(-rows // high) * across, values.get(NO_DATA)
    missing = float(no_data[0].split(b"\0")[0]) if no_data else None

    target = arrow_schema(BLOCKS)

    def decoded(data: bytes, height: int) -> np.ndarray:
        raw = np.frombuffer(data if compression == 1 else zlib.decompress(data), dtype)[: height * wide].reshape(height, wide)
        raw = np.cumsum(raw, axis=1, dtype=dtype.newbyteorder("=")) if predictor == 2 else raw
        z = raw.astype("<f8")
        return z if missing is None or np.isnan(missing) else np.where(z == missing, np.nan, z)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray | None]]:
        with _open(path) as f:
            for batch in batches:
                for first in batch.column(0).to_pylist():
                    last = min(total, first + TILES_A_RANGE)
                    found = []
                    for kind, _, where in lists:
                        code = np.dtype(f"{order}{ {3: 'u2', 4: 'u4', 16: 'u8'}[kind] }")
                        f.seek(where + first * code.itemsize)
                        found.append(np.frombuffer(f.read((last - first) * code.itemsize), code).tolist())
                    for i, at, size in zip(range(first, last), *found, strict=True):
                        f.seek(at)
                        yield i, decoded(f.read(size), min(high, rows - i * high) if not tiled else high) if size else None

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for i, z in pieces(batches):
            z = np.full((high, wide), np.nan) if z is None else z.copy()
            tr, tc = divmod(i, across)
            z[max(0, rows - tr * high) :], z[:, max(0, cols - tc * wide) :] = np.nan, np.nan
            yield from as_table(row_of_values(tr, tc, z), target).to_batches()

    def strips(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for i, z in pieces(batches):
            if z is not None:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(i * high, i * high + len(z)), pa.int32()), pa.array(list(z), pa.list_(pa.float64()))], names=["r", "values"])

    work = spark.range(0, total, TILES_A_RANGE).repartition(max(1, min(-(-total // TILES_A_RANGE), 10_000)), "id")
    if tiled:
        return Blocks(work.mapInArrow(blocks, BLOCKS), _grid(values, (rows, cols)), wide, name)
    return RowArrays(work.mapInArrow(strips, "r int, values array<double>"), _grid(values, (rows, cols)), name=name)
