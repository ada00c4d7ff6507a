"""Point clouds: gridding, ground classification, filters, merges, trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillwork.grid import GridMeta

HOW = {"min": F.min, "max": F.max, "mean": F.avg, "median": F.median}


def place(points: DataFrame, grid: GridMeta) -> DataFrame:
    """points with the cell (r, c) of each; points outside fall into the edge cells."""
    at = lambda v, o, d, n: F.greatest(F.lit(0), F.least(F.lit(n - 1), F.floor((F.col(v) - o) / d))).cast("int")
    return points.withColumns({"r": at("y", grid.y0, grid.dy, grid.rows), "c": at("x", grid.x0, grid.dx, grid.cols)})


def dense(spark, grid: GridMeta) -> DataFrame:
    """Every cell of the grid, made where the tasks are."""
    n = spark.range(grid.rows * grid.cols)
    return n.select((F.col("id") / grid.cols).cast("int").alias("r"), (F.col("id") % grid.cols).cast("int").alias("c"))


def grid_points(points: DataFrame, grid: GridMeta, how: str = "min") -> DataFrame:
    """(r, c, z) of every cell; empty cells are null, with ``count`` 0."""
    if how != "count" and how not in HOW:
        raise ValueError(f"how is one of {[*HOW, 'count']}")
    placed = place(points, grid).groupBy("r", "c").agg((F.count("*").cast("double") if how == "count" else HOW[how]("z")).alias("z"))
    out = dense(points.sparkSession, grid).join(placed, ["r", "c"], "left")
    return out.fillna(0.0, ["z"]) if how == "count" else out


def filter_classes(points: DataFrame, classes: list[int]) -> DataFrame:
    if "classification" not in points.columns:
        raise ValueError("the points have no classification")
    return points.where(F.col("classification").isin(*classes))


def subset(points: DataFrame, chosen: Column | str) -> DataFrame:
    """The points for which a condition on their columns is true (not null), with all columns; a condition of another type is an error."""
    kept = points.select("*", (F.expr(chosen) if isinstance(chosen, str) else chosen).alias("__chosen"))
    if kept.schema["__chosen"].dataType.simpleString() != "boolean":
        raise ValueError("the condition is not true or false")
    return kept.where("__chosen").drop("__chosen")


def merge(*clouds: DataFrame) -> DataFrame:
    """The union of clouds over the columns that all of them have."""
    if not clouds:
        raise ValueError("nothing to merge")
    shared = [c for c in clouds[0].columns if all(c in x.columns for x in clouds)]
    out = clouds[0].select(*shared)
    for x in clouds[1:]:
        out = out.unionByName(x.select(*shared))
    return out


def _extreme(cells: DataFrame, grid: GridMeta, window: int, least: bool) -> DataFrame:
    """Window minimum or maximum; reflected edges add no new values to it for windows up to the grid's size."""
    lo, hi = -(window // 2), window - window // 2 - 1
    send = lambda col, n: F.array_distinct(F.filter(F.transform(F.sequence(F.lit(lo), F.lit(hi)), lambda d: F.col(col) - d), lambda p: (p >= 0) & (p < n)))
    take = F.min if least else F.max
    across = cells.withColumn("c", F.explode(send("c", grid.cols))).groupBy("r", "c").agg(take("z").alias("z"))
    return across.withColumn("r", F.explode(send("r", grid.rows))).groupBy("r", "c").agg(take("z").alias("z"))


def classify_ground(points: DataFrame, grid: GridMeta, window: int = 3, threshold: float = 0.5) -> DataFrame:
    """points with classification 2 (ground) within ``threshold`` of the opened minimum surface, else 1."""
    low = grid_points(points, grid, "min")
    surface = low.fillna(points.agg(F.min("z")).first()[0] or 0.0, ["z"])
    opened = _extreme(_extreme(surface, grid, window, True), grid, window, False).withColumnRenamed("z", "floor")
    placed = place(points.drop("classification"), grid).join(opened, ["r", "c"])
    return placed.withColumn("classification", F.when(F.col("z") - F.col("floor") <= threshold, 2).otherwise(1)).drop("floor", "r", "c")


def detect_trees(canopy: DataFrame, grid: GridMeta, min_height: float = 2.0, radius=lambda h: 0.5 + 0.05 * h) -> DataFrame:
    """(r, c, height): cells that no cell of the window around them exceeds; its radius depends on the height."""
    tops = canopy.where(F.col("z") >= min_height).withColumn("rad", F.greatest(F.lit(1), F.floor(radius(F.col("z")) / abs(grid.dx)).cast("int")))
    spread = lambda p: F.sequence(F.col(p) - F.col("rad"), F.col(p) + F.col("rad"))
    seen = tops.select("r", "c", "z", F.explode(spread("r")).alias("nr"), "rad").select("r", "c", "z", "nr", F.explode(spread("c")).alias("nc"))
    seen = seen.join(canopy.select(F.col("r").alias("nr"), F.col("c").alias("nc"), F.col("z").alias("zn")), ["nr", "nc"])
    return seen.groupBy("r", "c", "z").agg(F.max("zn").alias("top")).where("z >= top").select("r", "c", F.col("z").alias("height"))


