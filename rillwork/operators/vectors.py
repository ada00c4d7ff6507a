"""Lines and polygons on grids: burning, lifting, flattening and clipping.

lines(id, points: array of (x, y)); polygons(id, rings: array of rings, each an array of (x, y)), holes as further
rings by the even-odd rule. Shapes are turned into cells row by row, so only cells that they cover become rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillwork.grid import GridMeta
from rillwork.operators.conditioning import fill_depressions

STATS = {"min": F.min, "mean": F.avg, "median": F.median}


def _pairs(points: Column) -> Column:
    """Neighbouring elements of an array as (a, b)."""
    n = F.size(points)
    return F.zip_with(F.slice(points, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(points, F.lit(2), F.greatest(n - 1, F.lit(0))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def line_cells(lines: DataFrame, grid: GridMeta) -> DataFrame:
    """(id, r, c): the cells that samples of each segment fall in, two samples for each cell of its longer side."""
    s = lines.select("id", F.explode(_pairs(F.col("points"))).alias("s"))
    row, col = (lambda p: (F.col(f"s.{p}.y") - grid.y0) / grid.dy), (lambda p: (F.col(f"s.{p}.x") - grid.x0) / grid.dx)
    s = s.select("id", row("a").alias("r1"), col("a").alias("c1"), (row("b") - row("a")).alias("dr"), (col("b") - col("a")).alias("dc"))
    s = s.withColumn("n", 2 * F.greatest(F.floor(F.abs("dr")), F.floor(F.abs("dc")), F.lit(1))).withColumn("t", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n")))).withColumn("t", F.col("t") / F.col("n"))
    cells = s.select("id", F.floor(F.col("r1") + F.col("t") * F.col("dr")).cast("int").alias("r"), F.floor(F.col("c1") + F.col("t") * F.col("dc")).cast("int").alias("c"))
    return cells.where(grid.inside(F.col("r"), F.col("c"))).distinct()


def polygon_cells(polygons: DataFrame, grid: GridMeta) -> DataFrame:
    """(id, r, c): cells whose centre lies inside, from the spans between crossings of each row's centre line."""
    edges = F.flatten(F.transform("rings", lambda ring: _pairs(F.concat(ring, F.slice(ring, 1, 1)))))
    ys = F.transform(F.flatten("rings"), lambda p: p["y"])
    cell = lambda y: F.floor((y - grid.y0) / grid.dy).cast("int")
    spread = polygons.select("id", edges.alias("edges"), F.greatest(F.lit(0), cell(F.array_max(ys))).alias("first"), F.least(F.lit(grid.rows - 1), cell(F.array_min(ys))).alias("last"))
    rows = spread.where("first <= last").select("id", "edges", F.explode(F.sequence("first", "last")).alias("r")).withColumn("y", grid.y0 + (F.col("r") + 0.5) * grid.dy)
    cut = F.filter("edges", lambda e: (e["a"]["y"] > F.col("y")) != (e["b"]["y"] > F.col("y")))
    at = F.transform(cut, lambda e: e["a"]["x"] + (F.col("y") - e["a"]["y"]) / (e["b"]["y"] - e["a"]["y"]) * (e["b"]["x"] - e["a"]["x"]))
    column = F.transform(F.array_sort(at), lambda x: F.ceil((x - grid.x0) / grid.dx - 0.5).cast("int"))
    rows = rows.select("id", "r", column.alias("x")).where("size(x) > 0")
    spans = rows.select("id", "r", "x", F.explode(F.sequence(F.lit(1), F.size("x"), F.lit(2))).alias("i"))
    spans = spans.select("id", "r", F.greatest(F.lit(0), F.element_at("x", F.col("i"))).alias("lo"), F.least(F.lit(grid.cols - 1), F.element_at("x", F.col("i") + 1) - 1).alias("hi")).where("lo <= hi")
    return spans.select("id", "r", F.explode(F.sequence("lo", "hi")).alias("c"))


def _lowered(cells: DataFrame, drops: DataFrame) -> DataFrame:
    return cells.join(drops, ["r", "c"], "left").select("r", "c", (F.col("z") - F.coalesce("drop", F.lit(0.0))).alias("z"))


def _once(shapes: DataFrame, drop: float) -> DataFrame:
    return shapes.select("r", "c").distinct().withColumn("drop", F.lit(float(drop)))


def burn_streams(cells: DataFrame, lines: DataFrame, grid: GridMeta, drop: float = 1.0) -> DataFrame:
    """(r, c, z): the lines' cells lowered by ``drop``, then depressions filled."""
    return fill_depressions(_lowered(cells, _once(line_cells(lines, grid), drop)), grid)


def burn_agree(cells: DataFrame, lines: DataFrame, grid: GridMeta, sharp: float, smooth: float, buffer: int) -> DataFrame:
    """(r, c, z): within ``buffer`` cells of a line lowered by ``smooth`` and a share of ``sharp`` that falls off evenly from the line."""
    offsets = lambda col: F.sequence(F.col(col) - buffer, F.col(col) + buffer)
    near = line_cells(lines, grid).select("r", "c").distinct().select("r", "c", F.explode(offsets("r")).alias("nr")).select("r", "c", "nr", F.explode(offsets("c")).alias("nc"))
    far = near.groupBy(F.col("nr").alias("r"), F.col("nc").alias("c")).agg(F.min(F.greatest(F.abs(F.col("r") - F.col("nr")), F.abs(F.col("c") - F.col("nc")))).alias("d"))
    return _lowered(cells, far.select("r", "c", (sharp * (1 - F.col("d") / max(buffer, 1)) + smooth).alias("drop")))


def enforce_culverts(cells: DataFrame, roads: DataFrame, lines: DataFrame, grid: GridMeta, drop: float = 1.0) -> DataFrame:
    """(r, c, z): cells that both a road and a stream line pass lowered by ``drop``."""
    both = line_cells(roads, grid).select("r", "c").intersect(line_cells(lines, grid).select("r", "c"))
    return _lowered(cells, _once(both, drop))


def enforce_breaklines(cells: DataFrame, lines: DataFrame, grid: GridMeta, lift: float = 1.0) -> DataFrame:
    """(r, c, z): the lines' cells raised by ``lift``, once however many lines pass."""
    return _lowered(cells, _once(line_cells(lines, grid), -lift))


def burn_buildings(cells: DataFrame, polygons: DataFrame, grid: GridMeta, lift: float = 10.0) -> DataFrame:
    """(r, c, z): cells raised by ``lift`` for each polygon that covers them."""
    return _lowered(cells, polygon_cells(polygons, grid).groupBy("r", "c").agg((F.count("*") * -lift).alias("drop")))


def hydroflatten(cells: DataFrame, polygons: DataFrame, grid: GridMeta, method: str = "min") -> DataFrame:
    """(r, c, z): each polygon's cells, without data too, set to one statistic of its cells with data.

    Every statistic is of the input; where polygons overlap, the highest id gives the level.
    """
    if method not in STATS:
        raise ValueError(f"method is one of {[*STATS]}")
    covered = polygon_cells(polygons, grid).join(cells, ["r", "c"])
    level = covered.groupBy("id").agg(STATS[method]("z").alias("level")).where("level is not null")
    last = covered.join(level, "id").groupBy("r", "c").agg(F.max(F.struct("id", "level")).alias("b")).select("r", "c", "b.level")
    return cells.join(last, ["r", "c"], "left").select("r", "c", F.coalesce("level", "z").alias("z"))


def clip(points: DataFrame, rings: list[list[tuple[float, float]]], inverse: bool = False) -> DataFrame:
    """The points inside the polygon's rings, or outside of them."""
    crossings = F.lit(0)
    for ring in rings:
        for (ax, ay), (bx, by) in zip(ring, [*ring[1:], ring[0]], strict=True):
            if ay != by:
                passed = ((F.lit(ay) > F.col("y")) != (F.lit(by) > F.col("y"))) & (F.col("x") < ax + (F.col("y") - ay) / (by - ay) * (bx - ax))
                crossings = crossings + passed.cast("int")
    inside = crossings % 2 == 1
    return points.where(~inside if inverse else inside)
