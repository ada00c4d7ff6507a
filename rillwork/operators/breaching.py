"""Breaching: channels cut from pits to lower ground, in the order of the pits' heights.

What one pit's channel changes can matter to the next, so pits take turns by (height, row, column). A
channel stays within ``max_length`` steps of its pit, so a pit waits only for earlier pits within twice that
reach. In a round each tile, with a ring that wide, works on its pits in turn, but for those that
wait for a pit of another tile; the changes are joined to the raster and the next round sees them. The
result is that of all pits one by one. An unbounded reach would make every pit wait for every other, so
``max_length`` is required here.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillwork.grid import GridMeta
from rillwork.operators.conditioning import fill_depressions
from rillwork.operators.terrain import local_minima
from rillwork.plans.blocks import TILE, Block, arrow_schema, as_table, block_of, in_tiles
from rillwork.plans.store import settle

#: Neighbours row by row: the order in which equal ways are tried.
AROUND = [(dr, dc) for dr in (-1, 0, 1) for dc in (-1, 0, 1) if dr or dc]
TWO_AWAY = [(dr, dc) for dr in range(-2, 3) for dc in range(-2, 3) if max(abs(dr), abs(dc)) == 2]
METHODS = ("single_cell", "least_cost", "hybrid")
#: Data, no data inside the grid, outside of it.
DATA, HOLE, OFF = 0, 1, 2
#: The cells that a pit's channel lowers; None where no way was found.
Pit = Callable[[np.ndarray, np.ndarray, int, int], list | None]


def _one_cell(z: np.ndarray, kind: np.ndarray, r: int, c: int) -> list | None:
    """The first cell two steps away that is lower (or without data) and has a higher cell between: that one is lowered."""
    for dr, dc in TWO_AWAY:
        far = kind[r + dr, c + dc]
        if far == OFF or (far == DATA and not z[r + dr, c + dc] < z[r, c]):
            continue
        level = z[r, c] if far == HOLE else (z[r, c] + z[r + dr, c + dc]) / 2
        for er, ec in AROUND:
            between = max(abs(dr - er), abs(dc - ec)) <= 1
            if between and kind[r + er, c + ec] == DATA and z[r + er, c + ec] > level:
                return [(r + er, c + ec, level)]
    return None


def _cheapest(fall: float, max_length: int, max_depth: float | None) -> Pit:
    """Cuts along the way on which least has to be dug to a cell as low as a channel falling by ``fall`` a step would be there."""

    def cut(z: np.ndarray, kind: np.ndarray, r: int, c: int) -> list | None:
        around = [(r + dr, c + dc) for dr, dc in AROUND]
        valid = [p for p in around if kind[p] == DATA]
        if not valid or not all(z[r, c] < z[p] for p in valid):
            return []
        start, cost, came, hops, closed, n = (r, c), {(r, c): 0.0}, {}, {(r, c): 0}, set(), 0
        heap = [(0.0, 0, start)]
        while heap:
            dug, _, at = heapq.heappop(heap)
            if at in closed:
                continue
            closed.add(at)
            if max_depth is not None and dug > max_depth:
                return None
            step = hops[at] + 1
            if step > max_length:
                continue
            for dr, dc in AROUND:
                to = (at[0] + dr, at[1] + dc)
                if kind[to] == OFF or to in closed:
                    continue
                level = z[start] - step * fall
                if kind[to] == HOLE or z[to] <= level:
                    channel = []
                    while at != start:
                        depth = z[start] - hops[at] * fall
                        if z[at] > depth:
                            channel.append((*at, depth))
                        at = came[at]
                    return channel
                more = dug + max(0.0, z[to] - level)
                if more < cost.get(to, np.inf):
                    n += 1
                    cost[to], came[to], hops[to] = more, at, step
                    heapq.heappush(heap, (more, n, to))
        return None

    return cut


def _turns(block: Block, pits: pa.Table, grid: GridMeta, cut: Pit, reach: int) -> dict:
    """The tile's pits that wait for no pit elsewhere, in turn: changed cells (z), and pits that have had their turn (z null)."""
    h, t = block.halo, block.tile
    z = block.arrays["z"].copy()
    rr, cc = np.ogrid[: t + 2 * h, : t + 2 * h]
    rr, cc = rr + block.r0 - h, cc + block.c0 - h
    kind = np.where((rr < 0) | (rr >= grid.rows) | (cc < 0) | (cc >= grid.cols), OFF, np.where(np.isnan(z), HOLE, DATA))
    pr, pc = pits.column("r").to_numpy() - block.r0 + h, pits.column("c").to_numpy() - block.c0 + h
    own = (pr >= h) & (pr < h + t) & (pc >= h) & (pc < h + t)
    waiting = np.zeros(z.shape, bool)  # pits that stay for a later round
    near, changed, done, failed = 2 * reach + 1, {}, [], []
    for i in np.lexsort((pc, pr, pits.column("level").to_numpy())).tolist():
        r, c = int(pr[i]), int(pc[i])
        if not own[i] or waiting[r - near : r + near + 1, c - near : c + near + 1].any():
            waiting[r, c] = True
            continue
        lowered = cut(z, kind, r, c)
        for a, b, level in lowered or ():
            z[a, b] = level
            changed[a, b] = level
        done.append((r, c)), failed.append(lowered is None)
    places = [*changed, *done]
    return {
        "r": [a + block.r0 - h for a, _ in places], "c": [b + block.c0 - h for _, b in places],
        "z": [*changed.values(), *[None] * len(done)], "failed": [*[False] * len(changed), *failed],
    }


def _breached(cells: DataFrame, grid: GridMeta, pits: DataFrame, cut: Pit, reach: int, tile: int) -> tuple[DataFrame, bool]:
    """cells with the channels of all pits(r, c) cut in the order of the pits' heights in ``cells``; whether any pit failed."""
    halo = 3 * reach + 2  # a pit, those it may wait for, and what its channel may touch
    schema = "r int, c int, z double, failed boolean"
    target, state, failed = arrow_schema(schema), cells, False
    left = settle(pits.join(cells, ["r", "c"]).select("r", "c", F.col("z").alias("level")), "pits")

    def run(t: pa.Table, p: pa.Table) -> pa.Table:
        return as_table(_turns(block_of(t, tile, halo, ("z",)), p, grid, cut, reach), target) if t.num_rows and p.num_rows else target.empty_table()

    while not left.isEmpty():
        seen = settle(in_tiles(left, grid, tile, halo), "pits")
        busy = seen.where((F.floor(F.col("r") / tile) == F.col("tr")) & (F.floor(F.col("c") / tile) == F.col("tc"))).select("tr", "tc").distinct()
        blocks = in_tiles(state.where("z is not null"), grid, tile, halo).join(F.broadcast(busy), ["tr", "tc"], "left_semi")
        moved = settle(blocks.groupBy("tr", "tc").cogroup(seen.groupBy("tr", "tc")).applyInArrow(run, schema), "channels")
        lower = moved.where("z is not null").groupBy("r", "c").agg(F.min("z").alias("low"))
        state = settle(state.join(lower, ["r", "c"], "left").select("r", "c", F.least("z", "low").alias("z")), "breached")
        failed = failed or not moved.where("failed").isEmpty()
        left = settle(left.join(moved.where("z is null").select("r", "c"), ["r", "c"], "left_anti"), "pits")
    return state, failed


def breach_depressions(
    cells: DataFrame, grid: GridMeta, method: str = "least_cost", max_length: int = 16, max_depth: float | None = None, fill_remaining: bool = True, tile: int = TILE
) -> DataFrame:
    """(r, c, z) with channels cut from interior pits; heights only fall, except where ``hybrid`` fills what is left.

    ``single_cell`` lowers one cell beside a pit; the other methods do so first and then cut channels of at most
    ``max_length`` steps and ``max_depth`` of digging. Places without data are outlets, the grid's edge is not.
    ``hybrid`` fills all remaining depressions, if a pit was left and ``fill_remaining``.
    """
    if method not in METHODS:
        raise ValueError(f"method is one of {METHODS}")
    if max_length < 1:
        raise ValueError("max_length must be at least 1")
    start = settle(cells.select("r", "c", F.col("z").cast("double").alias("z")), "surface")
    state, _ = _breached(start, grid, local_minima(start, grid), _one_cell, 2, tile)
    if method == "single_cell":
        return state
    extent = state.agg(F.max("z") - F.min("z")).first()[0]
    fall = max(extent or 0.0, 1.0) * 1e-9
    state, failed = _breached(state, grid, local_minima(state, grid), _cheapest(fall, max_length, max_depth), max_length, tile)
    if method == "hybrid" and fill_remaining and failed:
        state = fill_depressions(state, grid)
    return state


def burn_by_breaching(cells: DataFrame, stream_cells: DataFrame, grid: GridMeta, constant_drop: float, max_length: int = 16, max_depth: float | None = None) -> DataFrame:
    """(r, c, z): stream cells(r, c) lowered by ``constant_drop``, then ``hybrid`` breaching, whose channels lead to them."""
    burnt = cells.join(stream_cells.select("r", "c").distinct().withColumn("wet", F.lit(True)), ["r", "c"], "left")
    lowered = burnt.select("r", "c", (F.col("z") - F.when(F.col("wet"), constant_drop).otherwise(0.0)).alias("z"))
    return breach_depressions(lowered, grid, "hybrid", max_length, max_depth)
