"""Nearest points, inverse distances and relaxation over grids."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rillwork.grid import GridMeta
from rillwork.operators.points import dense
from rillwork.plans.store import settle


def nearest(targets: DataFrame, points: DataFrame, k: int = 1) -> DataFrame:
    """targets(r, c, x, y), points(x, y, z) -> (r, c, d2, z, place): the k nearest points of each target, by y, x and z on ties.

    Points lie in square buckets of about k each. A target looks at the buckets around its own, and once more twice
    as far while its k-th point may not be the k-th nearest; only such targets go on. Of points at one place k count.
    """
    spread = points.agg(F.count("*"), F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    n, x0, x1, y0, y1 = spread
    if not n:
        return targets.select("r", "c", F.lit(None).cast("double").alias("d2"), F.lit(None).cast("double").alias("z"), F.lit(None).cast("int").alias("place")).limit(0)
    k = min(k, n)
    side = max(math.sqrt(max(x1 - x0, 1e-9) * max(y1 - y0, 1e-9) * k / n), max(x1 - x0, y1 - y0) / 1e6, 1e-9)
    bucket = lambda v, o: F.floor((F.col(v) - o) / side)
    few = points.withColumn("i", F.row_number().over(Window.partitionBy("x", "y").orderBy("z"))).where(F.col("i") <= k)
    placed = settle(few.select(bucket("x", x0).alias("bx"), bucket("y", y0).alias("by"), F.col("x").alias("px"), F.col("y").alias("py"), "z"), "buckets")
    left, parts, ring = settle(targets.select("r", "c", "x", "y"), "targets"), [], 1
    while not left.isEmpty():
        # buckets outside of the points' extent hold nothing
        span = lambda v, o, hi: F.sequence(F.greatest(bucket(v, o) - ring, F.lit(0)), F.least(bucket(v, o) + ring, F.lit(math.floor((hi - o) / side))))  # noqa: B023, E731
        fits = lambda v, o, hi: (bucket(v, o) + ring >= 0) & (bucket(v, o) - ring <= math.floor((hi - o) / side))  # noqa: B023, E731
        near = left.where(fits("x", x0, x1) & fits("y", y0, y1)).withColumn("bx", F.explode(span("x", x0, x1))).withColumn("by", F.explode(span("y", y0, y1)))
        near = near.join(placed, ["bx", "by"]).withColumn("d2", (F.col("px") - F.col("x")) ** 2 + (F.col("py") - F.col("y")) ** 2)
        ranked = near.withColumn("place", F.row_number().over(Window.partitionBy("r", "c").orderBy("d2", "py", "px", "z"))).where(F.col("place") <= k)
        sure = F.sum(F.when(F.col("d2") <= (ring * side) ** 2, 1).otherwise(0)).over(Window.partitionBy("r", "c")) >= k
        whole = ring * side > math.hypot(x1 - x0, y1 - y0) * 4 + side
        done = settle(ranked.withColumn("sure", sure).where(F.lit(whole) | F.col("sure")).select("r", "c", "d2", "z", "place"), "nearest")
        parts.append(done)
        left, ring = settle(left.join(done.select("r", "c").distinct(), ["r", "c"], "left_anti"), "targets"), ring * 2
    out = parts[0] if parts else settle(targets.selectExpr("r", "c", "0D as d2", "0D as z", "0 as place").limit(0), "nearest")
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.hint("merge")  # a union has none of its parts' hints


def centres(spark, grid: GridMeta) -> DataFrame:
    return dense(spark, grid).select("r", "c", (grid.x0 + (F.col("c") + 0.5) * grid.dx).alias("x"), (grid.y0 + (F.col("r") + 0.5) * grid.dy).alias("y"))


def nearest_points(points: DataFrame, grid: GridMeta) -> DataFrame:
    """(r, c, z) of the point nearest to each cell's centre."""
    return nearest(centres(points.sparkSession, grid), points).select("r", "c", "z")


def inverse_distance(points: DataFrame, grid: GridMeta, k: int = 8, power: float = 2.0) -> DataFrame:
    """(r, c, z): the k nearest points' mean, weighted by 1 / distance^power; a point on the centre gives its own z."""
    w = F.pow("d2", F.lit(-power / 2))
    near = nearest(centres(points.sparkSession, grid), points, k)
    mean = near.groupBy("r", "c").agg(F.min(F.when(F.col("place") == 1, F.struct("d2", "z"))).alias("first"), F.sum(F.when(F.col("d2") > 0, w * F.col("z"))).alias("t"), F.sum(F.when(F.col("d2") > 0, w)).alias("w"))
    return mean.select("r", "c", F.when(F.col("first.d2") == 0, F.col("first.z")).otherwise(F.col("t") / F.col("w")).alias("z"))


def hand_euclidean(cells: DataFrame, stream_cells: DataFrame) -> DataFrame:
    """(r, c, hand): height above the nearest stream cell with data, the first in row order on ties."""
    wet = cells.where("z is not null").join(stream_cells.where("stream").select("r", "c"), ["r", "c"]).select(F.col("c").cast("double").alias("x"), F.col("r").cast("double").alias("y"), "z")
    wet = settle(wet, "stream-cells")
    if wet.isEmpty():
        raise ValueError("no stream cell has data")
    at = cells.select("r", "c", F.col("c").cast("double").alias("x"), F.col("r").cast("double").alias("y"))
    return cells.join(nearest(at, wet).withColumnRenamed("z", "base"), ["r", "c"]).select("r", "c", (F.col("z") - F.col("base")).alias("hand"))


def _sides(z: np.ndarray) -> np.ndarray:
    p = np.pad(z, 1, mode="edge")
    return p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, 2:] + p[1:-1, :-2]


def _sweep(pdf: pd.DataFrame, sweeps: int, curved: bool) -> pd.DataFrame:
    """A tile and its halo, swept; the largest change of its own cells in each sweep goes along."""
    r0, c0 = pdf.r.min(), pdf.c.min()
    shape = (pdf.r.max() - r0 + 1, pdf.c.max() - c0 + 1)
    at = (pdf.r.to_numpy() - r0, pdf.c.to_numpy() - c0)
    z, fixed, own = np.zeros(shape), np.ones(shape, bool), np.zeros(shape, bool)
    z[at], fixed[at], own[at] = pdf.z, pdf.fixed, pdf.own
    change = []
    for _ in range(sweeps):
        around = _sides(z)
        new = (around - _sides(around - 4 * z) / 4) / 4 if curved else around / 4
        new = np.where(fixed, z, new)
        change.append(float(np.abs(new - z)[own].max(initial=0.0)))
        z = new
    kept = pdf[pdf.own]
    out = pd.DataFrame({"r": kept.r, "c": kept.c, "z": z[kept.r - r0, kept.c - c0], "fixed": kept.fixed})
    return out.assign(change=[change] + [None] * (len(out) - 1)) if len(out) else out.assign(change=None)


def relax(cells: DataFrame, grid: GridMeta, max_iter: int = 200, tol: float = 1e-3, biharmonic: bool = False, tile: int = 256, sweeps: int = 20) -> DataFrame:
    """(r, c, z) of a dense grid with cells without data filled in: each the mean of its four sides (edges replicated), or of least bending.

    All cells change at once in a sweep, from the mean of those with data on, until none changes by ``tol``. A job does
    several sweeps: tiles carry as wide a halo as values travel meanwhile, so the result is that of single sweeps.
    """
    start = cells.agg(F.avg("z")).first()[0]
    if start is None:
        raise ValueError("some cell must have data")
    state = settle(cells.select("r", "c", F.coalesce("z", F.lit(start)).alias("z"), F.col("z").isNotNull().alias("fixed")), "relax")
    done = 0
    while done < max_iter:
        todo = min(sweeps, max_iter - done)

        def run(n: int) -> DataFrame:
            halo = n * (2 if biharmonic else 1)
            tiles = lambda col: F.sequence(F.floor((F.col(col) - halo) / tile), F.floor((F.col(col) + halo) / tile))
            rows = state.select("r", "c", "z", "fixed", F.explode(tiles("r")).alias("tr")).select("*", F.explode(tiles("c")).alias("tc"))  # noqa: B023
            rows = rows.where((F.col("tr") >= 0) & (F.col("tc") >= 0) & (F.col("tr") <= (grid.rows - 1) // tile) & (F.col("tc") <= (grid.cols - 1) // tile))
            rows = rows.withColumn("own", (F.col("tr") == F.floor(F.col("r") / tile)) & (F.col("tc") == F.floor(F.col("c") / tile)))
            return settle(rows.groupBy("tr", "tc").applyInPandas(lambda pdf: _sweep(pdf, n, biharmonic), "r int, c int, z double, fixed boolean, change array<double>"), "relax")

        swept = run(todo)
        largest = swept.where("change is not null").agg(*(F.max(F.col("change")[i]) for i in range(todo))).first()
        stop = next((i + 1 for i, v in enumerate(largest) if v is not None and v < tol), None)
        if stop and stop < todo:
            swept = run(stop)
        state = swept.drop("change")
        if stop:
            break
        done += todo
    return state.select("r", "c", "z")
