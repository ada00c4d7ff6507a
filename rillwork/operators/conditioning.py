"""Depression filling, vector burning and block statistics."""

from __future__ import annotations

import heapq
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillwork.grid import GridMeta
from rillwork.operators.filling import filled
from rillwork.plans.blocks import Block, arrow_schema, as_table, block_of, in_tiles, steps
from rillwork.plans.stencil import window3
from rillwork.plans.store import settle


def seeds(cells: DataFrame, grid: GridMeta) -> DataFrame:
    """(r, c, seed): data cells on the border or beside no-data, where water leaves."""
    border = (F.col("r") == 0) | (F.col("c") == 0) | (F.col("r") == grid.rows - 1) | (F.col("c") == grid.cols - 1)
    beside = F.greatest(*(F.col(f"n{k}").isNull() for k in range(8)))
    return window3(cells).select("r", "c", (F.col("z").isNotNull() & (border | beside)).alias("seed"))


def _relax(block: Block, rule: Callable[[float, float, float], float], connectivity: int) -> dict:
    """Lowers w to the least level reachable in one tile, from its own cells and the ring around it."""
    side = block.tile + 2
    offsets = [dr * side + dc for _, dr, dc in steps(connectivity)]
    mine = np.zeros((side, side), bool)
    mine[1:-1, 1:-1] = block.own(block.have)
    pad = side + 1  # steps off the last row end here; those off the others end on the ring, which is not the tile's own
    own = [*mine.ravel().tolist(), *[False] * pad]
    z, w = block.arrays["z"].ravel().tolist(), np.where(block.have, block.arrays["w"], np.inf).ravel().tolist()
    heap = [(v, i) for i, v in enumerate(w) if v < np.inf]
    heapq.heapify(heap)
    while heap:
        v, i = heapq.heappop(heap)
        if v > w[i]:
            continue
        for o in offsets:
            j = i + o
            if own[j] and (level := rule(z[i], z[j], v)) < w[j]:
                w[j] = level
                heapq.heappush(heap, (level, j))
    level = np.array(w).reshape(side, side)[1:-1, 1:-1]
    rows = block.rows(block.own(block.have), z=block.own(block.arrays["z"]), w=level, moved=level < block.own(block.arrays["w"]))
    return {"run": [block.keys["run"]] * len(rows["r"])} | rows


def least_levels(start: DataFrame, grid: GridMeta, rule: Callable[[float, float, float], float], tile: int = 256, sides_only: bool = False) -> DataFrame:
    """start(run, r, c, z, w) with w lowered until no cell can be lowered from a neighbour.

    ``rule(z here, z there, w here)`` is the level that a neighbour gets; it never falls along a path. Tiles are
    worked on alone, with the levels of the ring around them, until none changes: levels only fall and the result is
    unique, whatever the order. A round moves levels across one tile, and works only on tiles whose ring has changed.
    """
    schema, keys = "run int, r int, c int, z double, w double, moved boolean", ["run", "tr", "tc"]
    target = arrow_schema(schema)
    own = [F.floor(F.col(x) / tile).cast("int").alias(f"t{x}") for x in "rc"]
    state = settle(start.select("run", "r", "c", "z", "w"), "levels")
    active = None
    while True:
        rows = in_tiles(state, grid, tile, 1)
        rows = rows if active is None else rows.join(active, keys, "left_semi")
        run = lambda t: as_table(_relax(block_of(t, tile, 1, ("z", "w"), ("run",)), rule, 4 if sides_only else 8), target)
        lowered = settle(rows.groupBy(*keys).applyInArrow(run, schema), "levels")
        rest = None if active is None else state.select("*", *own).join(active, keys, "left_anti").select("run", "r", "c", "z", "w")
        state = lowered.drop("moved") if rest is None else settle(lowered.drop("moved").unionByName(rest), "levels")
        if grid.rows <= tile and grid.cols <= tile:
            return state
        touched = in_tiles(lowered.where("moved"), grid, tile, 1).where((F.col("tr") != F.floor(F.col("r") / tile)) | (F.col("tc") != F.floor(F.col("c") / tile)))
        active = F.broadcast(settle(touched.select(*keys).distinct(), "active-tiles"))
        if active.isEmpty():
            return state


def fill_depressions(cells: DataFrame, grid: GridMeta, tile: int = 256, epsilon: float = 0.0) -> DataFrame:
    """(r, c, z): each cell raised to the lowest level over which it drains to a seed, ``epsilon`` higher with each step."""
    z = cells.where("z is not null")
    if epsilon == 0:
        state = filled(z.select(F.lit(0).alias("run"), "r", "c", "z"), grid, tile)
    else:  # out of a cell without data w stays infinite; such cells are no rows here
        start = z.join(seeds(cells, grid), ["r", "c"]).select(F.lit(0).alias("run"), "r", "c", "z", F.when(F.col("seed"), F.col("z")).otherwise(F.lit(float("inf"))).alias("w"))
        state = least_levels(start, grid, lambda _, there, v: max(there, v + epsilon), tile)
    return cells.select("r", "c").join(state.select("r", "c", F.col("w").alias("z")), ["r", "c"], "left")


def fill_sinks(cells: DataFrame, grid: GridMeta, **options) -> DataFrame:
    """The older name of ``fill_depressions``."""
    return fill_depressions(cells, grid, **options)


def stochastic_depressions(cells: DataFrame, grid: GridMeta, sigma: float, runs: int, seed: int = 0, tile: int = 256) -> DataFrame:
    """(r, c, p): the share of runs with normal noise in which filling raises the cell. The noise is a hash of seed, run and cell, whatever the partitions."""
    noisy = cells.where("z is not null").withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(runs - 1)))).select("run", "r", "c", (F.col("z") + sigma * noise(seed)).alias("z"))
    share = filled(noisy, grid, tile).groupBy("r", "c").agg(F.avg((F.col("w") > F.col("z")).cast("double")).alias("p"))
    return cells.select("r", "c").join(share, ["r", "c"], "left")


def noise(seed: int) -> Column:
    """Standard normal noise of (run, r, c)."""
    chance = lambda k: (F.pmod(F.xxhash64(F.lit(seed), "run", "r", "c", F.lit(k)), F.lit(1 << 53)) + 1) / F.lit(float((1 << 53) + 1))
    return F.sqrt(-2 * F.log(chance(0))) * F.cos(2 * np.pi * chance(1))


def resolve_flats(cells: DataFrame, grid: GridMeta, epsilon: float = 1e-5, connectivity: int = 8, tile: int = 256) -> DataFrame:
    """(r, c, z): plateaus that have a way down lifted so that they drain to it; their cells beside lower ground stay.

    A plateau is a connected group of two or more cells of one level. A cell rises by ``epsilon`` times its steps
    from the low rim plus twice its steps short of the farthest from the high rim; rims count as 1.
    """
    if connectivity not in (4, 8):
        raise ValueError("connectivity is 4 or 8")
    around = [F.col(f"n{k}") for k in range(8)]
    steps = [n for k, n in enumerate(around) if k % 2 == 0 or connectivity == 8]
    have = lambda columns, test: F.greatest(*(F.coalesce(test(n), F.lit(False)) for n in columns))
    seen = window3(cells).where("z is not null").where(have(steps, lambda n: n == F.col("z")))
    flat = settle(seen.select(F.lit(0).alias("run"), "r", "c", "z", have(around, lambda n: n < F.col("z")).alias("low"), have(around, lambda n: n > F.col("z")).alias("high")), "flats")
    inf = F.lit(float("inf"))

    def levels(start: Column, step: int, name: str) -> DataFrame:
        out = least_levels(flat.withColumn("w", start), grid, lambda here, there, v: v + step if here == there else np.inf, tile, connectivity == 4)
        return out.select("r", "c", F.col("w").alias(name))

    parts = [levels(grid.node(F.col("r"), F.col("c")).cast("double"), 0, "plateau"), levels(F.when(F.col("low"), 1.0).otherwise(inf), 1, "from_low"), levels(F.when(F.col("high"), 1.0).otherwise(inf), 1, "from_high")]
    known = flat.drop("z")
    for part in parts:
        known = known.join(part, ["r", "c"])
    reached = F.when(F.col("from_high") < inf, F.col("from_high"))
    deepest = known.groupBy("plateau").agg(F.max("low").alias("drains"), F.max(reached).alias("deepest"))
    lifted = known.join(deepest, "plateau").where("drains and not low").select("r", "c", (epsilon * (2 * F.coalesce(F.col("deepest") - reached, F.lit(0.0)) + F.col("from_low"))).alias("lift"))
    return cells.join(lifted, ["r", "c"], "left").select("r", "c", (F.col("z") + F.coalesce("lift", F.lit(0.0))).alias("z"))


def planchon_darboux(cells: DataFrame, grid: GridMeta, epsilon: float, tile: int = 256) -> DataFrame:
    """(r, c, z): the surface on which each raised cell lies ``epsilon`` above the neighbour that it drains to."""
    if epsilon <= 0:
        raise ValueError("epsilon must be positive")
    return fill_depressions(cells, grid, tile, epsilon)


def subgrid_bathymetry(cells: DataFrame, grid: GridMeta, factor: int, bins: int) -> DataFrame:
    """(r, c, z_min, z_max, frac_below_1..bins) of blocks; remainders and empty blocks are left out, flat blocks give 1."""
    whole = cells.where((F.col("r") < grid.rows // factor * factor) & (F.col("c") < grid.cols // factor * factor) & F.col("z").isNotNull())
    cell = whole.select(F.floor(F.col("r") / factor).cast("int").alias("r"), F.floor(F.col("c") / factor).cast("int").alias("c"), "z")
    spread = cell.groupBy("r", "c").agg(F.min("z").alias("z_min"), F.max("z").alias("z_max"))
    level = lambda k: F.col("z_min") + k * (F.col("z_max") - F.col("z_min")) / bins
    share = [F.avg(F.when((F.col("z_max") == F.col("z_min")) | (F.col("z") <= level(k)), 1.0).otherwise(0.0)).alias(f"frac_below_{k}") for k in range(1, bins + 1)]
    return cell.join(spread, ["r", "c"]).groupBy("r", "c", "z_min", "z_max").agg(*share)
