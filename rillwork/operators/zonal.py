"""Fusion and zonal statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillwork.grid import GridMeta


def fuse(topo: DataFrame, bathy: DataFrame, blend: str = "max", shoreline: float = 0.0) -> DataFrame:
    """(r, c, z) from two rasters of one grid: max, min, topo_above or bathy_below the shoreline."""
    t, b = F.col("z"), F.col("zb")
    rules: dict[str, Column] = {
        "max": F.greatest(t, b), "min": F.least(t, b),
        "topo_above": F.when(F.coalesce(t >= shoreline, F.lit(False)), t).otherwise(b), "bathy_below": F.when(F.coalesce(b <= shoreline, F.lit(False)), b).otherwise(t),
    }
    if blend not in rules:
        raise ValueError(f"blend is one of {[*rules]}")
    return topo.join(bathy.withColumnRenamed("z", "zb"), ["r", "c"]).select("r", "c", rules[blend].alias("z"))


def basin_statistics(labels: DataFrame, cells: DataFrame, grid: GridMeta) -> DataFrame:
    """One row per basin (0 is none): area, centroid and elevation statistics; deviations are of the population."""
    rows = labels.where("basin_id <> 0").join(cells, ["r", "c"])
    out = rows.groupBy("basin_id").agg(
        (F.count("*") * abs(grid.dx * grid.dy) / 1e6).alias("area_km2"), (grid.x0 + (F.avg("c") + 0.5) * grid.dx).alias("centroid_x"), (grid.y0 + (F.avg("r") + 0.5) * grid.dy).alias("centroid_y"),
        F.min("z").alias("min_elev"), F.max("z").alias("max_elev"), F.avg("z").alias("mean_elev"), F.stddev_pop("z").alias("std_elev"),
    )
    spread = F.col("max_elev") - F.col("min_elev")
    return out.withColumn("hypsometric_integral", F.when(spread == 0, 0.0).otherwise((F.col("mean_elev") - F.col("min_elev")) / spread))


def basin_hydrology(labels: DataFrame, slope: DataFrame, lengths: DataFrame, stream_cells: DataFrame, directions: DataFrame, grid: GridMeta) -> DataFrame:
    """One row per basin (0 is none): mean slope, longest flow path, and stream length over area; a stream cell is as long as its step."""
    rows = labels.where("basin_id <> 0").join(slope, ["r", "c"]).join(lengths, ["r", "c"]).join(stream_cells, ["r", "c"]).join(directions, ["r", "c"])
    step = F.when(F.col("stream"), F.when(F.coalesce(F.col("dir") % 2, F.lit(0)) == 0, grid.step(0)).otherwise(grid.step(1))).otherwise(0.0)
    area = F.count("*") * abs(grid.dx * grid.dy) / 1e6
    return rows.groupBy("basin_id").agg(F.avg("slope").alias("mean_slope"), F.max("length").alias("longest_flow_path_m"), (F.sum(step) / 1000 / area).alias("drainage_density_km_per_km2"))
