"""Flow directions, accumulation and what follows from them on the D8 forest."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillwork.grid import DC, DR, GridMeta
from rillwork.operators.terrain import slopes
from rillwork.plans.arrays import Blocks
from rillwork.plans.doubling import downstream
from rillwork.plans.drainage import along_paths, passed_down, upstream_lengths, upstream_totals
from rillwork.plans.stencil import window3
from rillwork.plans.store import settle


def flow_direction_d8(cells: DataFrame, grid: GridMeta, forced: DataFrame | None = None) -> DataFrame:
    """(r, c, dir): the steepest drop, the lowest code on ties; null where nothing lies lower. ``forced``(r, c, dir) wins."""
    best = F.greatest(*(F.struct(F.coalesce(f"s{k}", F.lit(float("-inf"))).alias("s"), F.lit(-k).alias("k")) for k in range(8)))
    out = slopes(cells, grid).select("r", "c", best.alias("b")).select("r", "c", F.when(F.col("b.s") > 0, -F.col("b.k")).alias("dir"))
    return _with_forced(out, forced)


def flow_direction_mfd(cells: DataFrame, grid: GridMeta, exponent: float = 1.1, quinn: bool = True) -> DataFrame:
    """(r, c, fractions): shares of the drops, weighted by contour length (Quinn) or not (Holmgren); zeros in pits."""
    length = lambda k: (0.5 if k % 2 == 0 else 1 / (2 * math.sqrt(2))) if quinn else 1.0
    w = slopes(cells, grid).select("r", "c", *(F.coalesce(F.when(F.col(f"s{k}") > 0, F.pow(F.col(f"s{k}"), F.lit(float(exponent))) * length(k)), F.lit(0.0)).alias(f"w{k}") for k in range(8)))
    w = w.withColumn("t", sum((F.col(f"w{k}") for k in range(1, 8)), F.col("w0")))
    return w.select("r", "c", F.array(*(F.when(F.col("t") > 0, F.col(f"w{k}") / F.col("t")).otherwise(0.0) for k in range(8))).alias("fractions"))


def opposite_direction(code: Column) -> Column:
    """The code of the way back; null for what is no direction."""
    return F.when(code.between(0, 7), (code + 4) % 8)


def pour_points_at(points: DataFrame, grid: GridMeta) -> DataFrame:
    """points(id, x, y) -> (id, r, c), without those off the grid: pour points by their place on the map."""
    return outlets_at(points, grid).where("r >= 0").select("id", "r", "c")


def outlets_at(points: DataFrame, grid: GridMeta) -> DataFrame:
    """points(id, x, y) -> (id, r, c, x, y): each one's cell and that cell's centre; -1 and NaN off the grid. Fractions of cells are cut off towards the origin."""
    r, c = ((F.col("y") - grid.y0) / grid.dy).cast("int"), ((F.col("x") - grid.x0) / grid.dx).cast("int")
    placed = points.select("id", r.alias("r"), c.alias("c"))
    on = grid.inside(F.col("r"), F.col("c"))
    x, y = grid.x0 + (F.col("c") + 0.5) * grid.dx, grid.y0 + (F.col("r") + 0.5) * grid.dy
    off = lambda v, there: F.when(on, v).otherwise(F.lit(there))
    return placed.select("id", off(F.col("r"), -1).alias("r"), off(F.col("c"), -1).alias("c"), off(x, float("nan")).alias("x"), off(y, float("nan")).alias("y"))


def _with_forced(directions: DataFrame, forced: DataFrame | None) -> DataFrame:
    if forced is None:
        return directions
    return directions.join(forced.withColumnRenamed("dir", "f"), ["r", "c"], "left").select("r", "c", F.coalesce("f", "dir").alias("dir"))


def flow_direction_rho8(cells: DataFrame, grid: GridMeta, seed: int = 0, forced: DataFrame | None = None) -> DataFrame:
    """(r, c, dir): D8 with each side's drop divided by 2 - u, corners as they are; u is uniform by hash of seed, cell and side. ``forced``(r, c, dir) wins."""
    chance = lambda k: F.pmod(F.xxhash64(F.lit(seed), "r", "c", F.lit(k)), F.lit(1 << 53)) / F.lit(float(1 << 53))
    drop = lambda k: F.col(f"s{k}") / (2 - chance(k)) if k % 2 == 0 else F.col(f"s{k}")
    best = F.greatest(*(F.struct(F.coalesce(drop(k), F.lit(float("-inf"))).alias("s"), F.lit(-k).alias("k")) for k in range(8)))
    return _with_forced(slopes(cells, grid).select("r", "c", best.alias("b")).select("r", "c", F.when(F.col("b.s") > 0, -F.col("b.k")).alias("dir")), forced)


def flow_direction_dinf(cells: DataFrame, grid: GridMeta) -> DataFrame:
    """(r, c, angle, magnitude): the steepest descent over eight facets, radians from east; angle -1 and magnitude 0 where there is none.

    Facet i lies between i and i + 1 eighths of a turn; its side neighbour is at the even end, its corner at the odd one.
    """
    side_length, turn = abs(grid.dx), math.pi / 4
    facets = []
    for i in range(8):
        side, corner = (i, i + 1) if i % 2 == 0 else (i + 1, i)
        e1, e2 = (F.col(f"n{(6 - a) % 8}") for a in (side, corner))
        s1, s2, diagonal = (F.col("z") - e1) / side_length, (e1 - e2) / side_length, (F.col("z") - e2) / (side_length * math.sqrt(2))
        lean = F.atan2(s2, s1)
        s = F.when(lean < 0, s1).when(lean > turn, diagonal).otherwise(F.sqrt(s1 * s1 + s2 * s2))
        r = F.least(F.greatest(lean, F.lit(0.0)), F.lit(turn))
        angle = side * turn + (r if i % 2 == 0 else -r)
        facets.append(F.struct(F.when(e1.isNotNull() & e2.isNotNull() & (s > 0), s).otherwise(F.lit(float("-inf"))).alias("s"), F.lit(-i).alias("i"), angle.alias("a")))
    found = F.col("b.s") > 0
    whole = F.when(F.col("b.a") >= 2 * math.pi, F.col("b.a") - 2 * math.pi).otherwise(F.col("b.a"))
    return window3(cells).select("r", "c", F.greatest(*facets).alias("b")).select("r", "c", F.when(found, whole).otherwise(-1.0).alias("angle"), F.when(found, F.col("b.s")).otherwise(0.0).alias("magnitude"))


def dinf_edges(directions: DataFrame, grid: GridMeta) -> DataFrame:
    """(node, to, p): the two receivers of each angle; cells without an angle receive nothing. Shares within 1e-6 of 0 or 1 are snapped."""
    eighths = F.col("angle") / (math.pi / 4)
    whole, rest = F.floor(eighths), eighths - F.floor(eighths)
    share = F.when(rest < 1e-6, 0.0).when(rest > 1 - 1e-6, 1.0).otherwise(rest)
    out = directions.where("angle >= 0").select("r", "c", F.explode(F.array(F.struct(F.pmod(6 - whole, F.lit(8)).cast("int").alias("dir"), (1 - share).alias("p")), F.struct(F.pmod(5 - whole, F.lit(8)).cast("int").alias("dir"), share.alias("p")))).alias("e"))
    edges = out.select("r", "c", "e.dir", "e.p").select(grid.node(F.col("r"), F.col("c")).alias("node"), receiver(grid).alias("to"), "p").where("to is not null and p > 0")
    valid = directions.where("angle >= 0").select(grid.node(F.col("r"), F.col("c")).alias("to"))
    return edges.join(valid, "to", "left_semi").select("node", "to", "p")


def mfd_edges(directions: DataFrame, grid: GridMeta) -> DataFrame:
    """(node, to, p) from (r, c, fractions)."""
    e = directions.select("r", "c", F.posexplode("fractions").alias("dir", "p")).where("p > 0")
    return e.select(grid.node(F.col("r"), F.col("c")).alias("node"), receiver(grid).alias("to"), "p").where("to is not null")


def accumulate_edges(cells: DataFrame, edges: DataFrame, grid: GridMeta, weight: str | None = None) -> DataFrame:
    """(r, c, acc): weights of what lies upstream times the shares on the way."""
    return passed_down(cells.select("r", "c", (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w")), edges, grid)


def snap_pour_points(
    pour_points: DataFrame, acc: DataFrame, grid: GridMeta, radius: int | None = None, streams: DataFrame | None = None, radius_m: float | None = None, min_acc: float | None = None, report: bool = False
) -> DataFrame:
    """pour_points(id, r, c) -> (id, r, c, acc): the cell of most accumulation within ``radius``, or with ``streams`` the nearest stream cell; the first in row order on ties.

    The window is square, ``radius`` cells or ``radius_m`` units of the map to each side. Cells below ``min_acc`` are passed over.
    Points without a cell to snap to stay where they are, with null acc. ``report`` adds from_r, from_c and moved:
    the distance in units of the map, null for points that stay.
    """
    if (radius is None) == (radius_m is None):
        raise ValueError("one of radius and radius_m is given")
    if radius is None:
        radius = max(0, round(radius_m / abs(grid.dx)))
    steps = F.sequence(F.lit(-radius), F.lit(radius))
    near = pour_points.select("id", F.col("r").alias("pr"), F.col("c").alias("pc"), F.explode(steps).alias("i")).select("*", F.explode(steps).alias("j"))
    near = near.select("id", (F.col("pr") + F.col("i")).alias("r"), (F.col("pc") + F.col("j")).alias("c"), (F.col("i") * F.col("i") + F.col("j") * F.col("j")).alias("far"))
    seen = near.join(acc if min_acc is None else acc.where(F.col("acc") >= min_acc), ["r", "c"])
    if streams is not None:
        seen = seen.join(streams.where("stream").select("r", "c"), ["r", "c"], "left_semi")
    rank = F.struct((F.col("far").cast("double") if streams is not None else -F.col("acc")).alias("first"), "r", "c", "acc")
    best = seen.where("acc is not null").groupBy("id").agg(F.min(rank).alias("b"))
    found = pour_points.select("id", F.col("r").alias("from_r"), F.col("c").alias("from_c")).join(best, "id", "left")
    found = found.select("id", F.coalesce("b.r", "from_r").alias("r"), F.coalesce("b.c", "from_c").alias("c"), F.col("b.acc").alias("acc"), "from_r", "from_c")
    if not report:
        return found.drop("from_r", "from_c")
    gone = F.hypot((F.col("r") - F.col("from_r")) * abs(grid.dy), (F.col("c") - F.col("from_c")) * abs(grid.dx))
    return found.withColumn("moved", F.when(gone > 0, gone))


def receiver(grid: GridMeta, direction: str = "dir") -> Column:
    """The node that a cell flows to; null off the grid or without direction."""
    d = F.col(direction)
    dr, dc = (F.element_at(F.array(*(F.lit(x) for x in s)), d + 1) for s in (DR, DC))
    return F.when(d.between(0, 7) & grid.inside(F.col("r") + dr, F.col("c") + dc), grid.node(F.col("r") + dr, F.col("c") + dc))


def forest(directions: DataFrame, grid: GridMeta, *more: str) -> DataFrame:
    """directions(r, c, dir, more) -> (node, r, c, dir, ptr, more)."""
    return directions.select(grid.node(F.col("r"), F.col("c")).alias("node"), "r", "c", "dir", receiver(grid).alias("ptr"), *more)


def accumulate(directions: DataFrame, grid: GridMeta, weight: str | None = None) -> DataFrame:
    """(r, c, acc): the weights of all cells strictly upstream; each weighs 1 by default."""
    if isinstance(directions, Blocks):
        return upstream_totals(directions, grid)
    return upstream_totals(directions.select("r", "c", "dir", (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w")), grid)


def upslope_length(directions: DataFrame, grid: GridMeta) -> DataFrame:
    return upstream_lengths(directions.select("r", "c", "dir"), grid)


def streams(
    acc: DataFrame, threshold: float, grid: GridMeta | None = None, units: str = "cells", slope: DataFrame | None = None, exponent: float | None = None, envelope: DataFrame | None = None,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """(r, c, keep, stream): cells whose accumulation reaches the threshold, in cells or, by the grid's cells, in m2 or km2.

    With ``slope``(r, c, slope: rise over run) and ``exponent`` the threshold holds for accumulation times slope to the
    exponent, falling slopes counting as 0. Cells outside ``envelope``(r, c), or in it with a null ``z``, are no streams.
    """
    if units not in ("cells", "m2", "km2") or (slope is None) != (exponent is None) or units != "cells" and not grid:
        raise ValueError("units is cells, m2 or km2, the last two with a grid; slope and exponent come together")
    least = threshold if units == "cells" else threshold * (1e6 if units == "km2" else 1.0) / abs(grid.dx * grid.dy)
    support, inside = F.col("acc"), F.lit(True)
    if slope is not None:
        acc = acc.join(slope.select("r", "c", F.col("slope").alias("__slope")), ["r", "c"], "left")
        support = support * F.pow(F.greatest(F.col("__slope"), F.lit(0.0)), F.lit(float(exponent)))
    if envelope is not None:
        within = (envelope.where("z is not null") if "z" in envelope.columns else envelope).select("r", "c", F.lit(True).alias("__inside"))
        acc, inside = acc.join(within, ["r", "c"], "left"), F.col("__inside").isNotNull()
    return acc.select("r", "c", *keep, (F.coalesce(support >= least, F.lit(False)) & inside).alias("stream"))


def numbered(cells: DataFrame, name: str) -> DataFrame:
    """cells(r, c, ...) with ``name``: their number row by row from 1.

    A number is the count in the rows before (one row of the grid is one row here), plus the place in the row.
    """
    per_row = cells.groupBy("r").count()
    before = per_row.withColumn("before", F.coalesce(F.sum("count").over(Window.orderBy("r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("r", "before")
    placed = cells.withColumn("k", F.row_number().over(Window.partitionBy("r").orderBy("c"))).join(before, "r")
    return placed.withColumn(name, F.col("before") + F.col("k")).drop("before", "k")


def basins(directions: DataFrame, grid: GridMeta) -> DataFrame:
    """(r, c, basin_id): every cell without a direction is an outlet, numbered row by row from 1."""
    sinks = numbered(directions.where("dir is null or not dir between 0 and 7").select("r", "c"), "v").select("r", "c", "v")
    marked = directions.join(sinks, ["r", "c"], "left").select("r", "c", "dir", "v")
    return along_paths(marked, grid).select("r", "c", F.coalesce(F.col("v").cast("bigint"), F.lit(0).cast("bigint")).alias("basin_id"))


def merge_small(labels: DataFrame, grid: GridMeta, min_cells: int, into_neighbour: bool = False) -> DataFrame:
    """(r, c, basin_id): basins of fewer cells become 0, or part of the largest basin that touches them and is not small itself (the lower id on ties)."""
    sizes = labels.where("basin_id <> 0").groupBy("basin_id").agg(F.count("*").alias("n"))
    small = settle(sizes.where(F.col("n") < min_cells).select("basin_id", F.lit(True).alias("small")), "small-basins")
    marked = labels.join(small, "basin_id", "left")
    if not into_neighbour:
        return marked.select("r", "c", F.when(F.col("small"), F.lit(0)).otherwise(F.col("basin_id")).alias("basin_id"))
    around = F.array(*(F.struct((F.col("r") + dr).alias("r"), (F.col("c") + dc).alias("c")) for dr, dc in zip(DR, DC, strict=True)))
    rim = marked.where("small").select("basin_id", F.explode(around).alias("t")).select("basin_id", "t.r", "t.c").distinct()
    beside = marked.where("small is null and basin_id <> 0").select("r", "c", F.col("basin_id").alias("other"))
    pairs = rim.join(beside, ["r", "c"]).select("basin_id", "other").distinct().join(sizes.withColumnRenamed("basin_id", "other"), "other")
    best = pairs.groupBy("basin_id").agg(F.max(F.struct("n", (-F.col("other")).alias("other"))).alias("b")).select("basin_id", (-F.col("b.other")).alias("into"))
    return marked.join(best, "basin_id", "left").select("r", "c", F.when(F.col("small"), F.coalesce("into", F.lit(0))).otherwise(F.col("basin_id")).alias("basin_id"))


def isobasins(directions: DataFrame, acc: DataFrame, stream_cells: DataFrame, grid: GridMeta, target_km2: float) -> DataFrame:
    """(r, c, basin_id): basins of about the target's size, from stream cells where accumulation passes one more multiple of it than on any inflow.

    Heads have no inflow, so each is an outlet; where paths pass several outlets the first in row order counts.
    """
    if target_km2 <= 0:
        raise ValueError("the target area must be positive")
    size = max(1, round(target_km2 / (abs(grid.dx * grid.dy) / 1e6)))
    wet = settle(forest(directions.join(acc, ["r", "c"]).join(stream_cells.where("stream").select("r", "c"), ["r", "c"]), grid, "acc").withColumn("q", F.floor(F.col("acc") / size)), "stream-cells")
    above = wet.groupBy(F.col("ptr").alias("node")).agg(F.max("q").alias("above"))
    seeds = wet.join(above, "node", "left").where(F.col("q") > F.coalesce("above", F.lit(-1)))
    return watershed(directions, grid, settle(numbered(seeds.select("r", "c"), "id"), "outlets"), require_unique=True)


def watershed(directions: DataFrame, grid: GridMeta, pour_points: DataFrame, require_unique: bool = False) -> DataFrame:
    """pour_points(id, r, c) -> (r, c, basin_id): of the points on a cell's path the first by rank, 0 if there is none.

    The rank is the order of ids, or the reverse where basins need not be unique.
    """
    rank = F.col("id") if require_unique else -F.col("id")
    seeds = pour_points.groupBy("r", "c").agg(F.min(rank).alias("v"))
    found = along_paths(directions.join(seeds, ["r", "c"], "left").select("r", "c", "dir", "v"), grid, least=True)
    return found.select("r", "c", F.coalesce(F.abs("v"), F.lit(0.0)).cast("bigint").alias("basin_id"))


def hand(cells: DataFrame, directions: DataFrame, stream_cells: DataFrame, grid: GridMeta) -> DataFrame:
    """(r, c, hand): height above the first stream cell downstream; null without one."""
    nodes = directions.join(cells, ["r", "c"]).join(stream_cells, ["r", "c"])
    found = along_paths(nodes.select("r", "c", "dir", F.when(F.col("stream"), F.col("z")).alias("v")), grid)
    return found.join(cells, ["r", "c"]).select("r", "c", (F.col("z") - F.col("v")).alias("hand"))


def _exits(directions: DataFrame, acc: DataFrame, grid: GridMeta, factor: int) -> DataFrame:
    """(node, block, acc, exit) of cells in whole blocks: the side by which a cell's path leaves its block."""
    nodes = forest(directions.join(acc, ["r", "c"]), grid, "acc").withColumn("block", F.struct(F.floor(F.col("r") / factor).alias("br"), F.floor(F.col("c") / factor).alias("bc")))
    nodes = settle(nodes.join(nodes.select(F.col("node").alias("ptr"), F.col("block").alias("to")), "ptr", "left"), "blocks")
    code = F.lit(None).cast("int")
    for k in range(8):
        code = F.when((F.col("to.br") - F.col("block.br") == DR[k]) & (F.col("to.bc") - F.col("block.bc") == DC[k]), F.lit(k)).otherwise(code)
    inside = nodes.withColumn("exit", code).withColumn("ptr", F.when(F.col("to") == F.col("block"), F.col("ptr")))
    found = downstream(inside, {"exit": lambda mine, below: F.coalesce(mine, below)}).select("node", "exit")
    whole = (F.col("block.br") < grid.rows // factor) & (F.col("block.bc") < grid.cols // factor)
    return nodes.where(whole).select("node", "block", "acc").join(found, "node")


def _coarse(blocks: DataFrame, direction: Column) -> DataFrame:
    return blocks.select(F.col("block.br").cast("int").alias("r"), F.col("block.bc").cast("int").alias("c"), direction.cast("int").alias("dir"))


def upscale_dmm(directions: DataFrame, acc: DataFrame, grid: GridMeta, factor: int, weighted: bool = False) -> DataFrame:
    """(r, c, dir) of whole blocks: each cell votes for the side by which its path leaves the block, with weight 1 or its accumulation."""
    votes = _exits(directions, acc, grid, factor)
    tally = votes.where("exit is not null").groupBy("block", "exit").agg(F.sum(F.col("acc") if weighted else F.lit(1.0)).alias("v"))
    best = tally.groupBy("block").agg(F.max(F.struct("v", (-F.col("exit")).alias("k"))).alias("b"))
    return _coarse(votes.select("block").distinct().join(best, "block", "left"), F.when(F.col("b.v") > 0, -F.col("b.k")))


def upscale_cotat(directions: DataFrame, acc: DataFrame, grid: GridMeta, factor: int) -> DataFrame:
    """(r, c, dir) of whole blocks: the side by which the path of the block's cell of most accumulation leaves it, the first cell in row order on ties."""
    top = _exits(directions, acc, grid, factor).groupBy("block").agg(F.max(F.struct("acc", (-F.col("node")).alias("node"), "exit")).alias("b"))
    return _coarse(top, F.col("b.exit"))


def coarse_elevation(cells: DataFrame, acc: DataFrame, grid: GridMeta, factor: int) -> DataFrame:
    """(r, c, z) of whole blocks: the elevation of the cell that ``upscale_cotat`` takes as the block's outlet."""
    block = [F.floor(F.col(x) / factor).cast("int").alias(f"b{x}") for x in "rc"]
    whole = cells.join(acc, ["r", "c"]).where((F.col("r") < grid.rows // factor * factor) & (F.col("c") < grid.cols // factor * factor))
    top = whole.groupBy(*block).agg(F.max(F.struct("acc", (-grid.node(F.col("r"), F.col("c"))).alias("node"), "z")).alias("b"))
    return top.select(F.col("br").alias("r"), F.col("bc").alias("c"), F.when(~F.isnan("b.z"), F.col("b.z")).alias("z"))
