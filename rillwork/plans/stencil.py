"""Neighbour gathers. Each cell is sent to the cells that look at it and combined there: one shuffle,
and where rows arrive in spatial order the map-side combine leaves little more than one row a cell."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillwork.grid import DC, DR, GridMeta
from rillwork.plans.arrays import Blocks, RowArrays, fits_focal, focal_arrays, window3_arrays


def window3(cells: DataFrame, value: str = "z") -> DataFrame:
    """(r, c, z, n0..n7): a cell and its eight neighbours by direction code; off-grid and no-data are null.

    Rasters of arrays take a tile kernel instead of the gather.
    """
    if isinstance(cells, RowArrays | Blocks):
        return window3_arrays(cells, value)
    targets = F.array(*(F.struct((F.col("r") - dr).alias("r"), (F.col("c") - dc).alias("c"), F.lit(k).alias("k")) for k, (dr, dc) in enumerate([*zip(DR, DC, strict=True), (0, 0)])))
    sent = cells.select(F.col(value).alias("v"), F.explode(targets).alias("t")).select("t.r", "t.c", "t.k", "v")
    at = lambda k: F.max(F.when(F.col("k") == k, F.col("v")))
    return sent.groupBy("r", "c").agg(at(8).alias(value), F.max(F.col("k") == 8).alias("own"), *(at(k).alias(f"n{k}") for k in range(8))).where("own").drop("own")


def clamped(grid: GridMeta, k: int, value: str = "z") -> Column:
    """Neighbour k of a window3 row with edges replicated and no-data neighbours 0."""
    r_in = (F.col("r") + DR[k] >= 0) & (F.col("r") + DR[k] < grid.rows)
    c_in = (F.col("c") + DC[k] >= 0) & (F.col("c") + DC[k] < grid.cols)
    code = {(dr, dc): j for j, (dr, dc) in enumerate(zip(DR, DC, strict=True))}
    pick = lambda dr, dc: F.col(value if (dr, dc) == (0, 0) else f"n{code[dr, dc]}")
    v = F.when(r_in & c_in, F.col(f"n{k}")).when(r_in, pick(DR[k], 0)).when(c_in, pick(0, DC[k])).otherwise(F.col(value))
    return F.coalesce(v, F.lit(0.0))


def window_sums(cells: DataFrame, grid: GridMeta, window: int, columns: list[str], edge: str = "reflect") -> DataFrame:
    """(r, c, columns): each column summed over the window, rows and columns of it one after the other."""
    lo, hi = -(window // 2), window - window // 2 - 1

    def positions(col: str, size: int) -> Column:
        """All places, mirrored ones too, that a cell takes part in, as offsets' targets."""
        p = F.col(col)
        mirrored = F.array(p, -p - 1, F.lit(2 * size - 1) - p) if edge == "reflect" else F.array(p, p - size, p + size)
        return F.flatten(F.transform(mirrored, lambda q: F.transform(F.sequence(F.lit(lo), F.lit(hi)), lambda d: q - d)))

    sums = [F.sum(x).alias(x) for x in columns]
    across = cells.withColumn("c", F.explode(positions("c", grid.cols))).where(f"c between 0 and {grid.cols - 1}").groupBy("r", "c").agg(*sums)
    return across.withColumn("r", F.explode(positions("r", grid.rows))).where(f"r between 0 and {grid.rows - 1}").groupBy("r", "c").agg(*sums)


def focal(cells: DataFrame, grid: GridMeta, window: int, edge: str = "reflect") -> DataFrame:
    """(r, c, z, m, sd): mean and population deviation of the valid cells of a window; ``edge`` reflects or wraps.

    Even windows reach one cell further back than ahead. The window's rows and columns are summed
    one after the other, so a cell is sent 2 * window times, not window squared. Rasters of arrays with reflected edges
    take running sums in tiles, whose cost does not depend on the window.
    """
    if isinstance(cells, RowArrays | Blocks):
        if edge == "reflect" and fits_focal(cells, window):
            return focal_arrays(cells, window)
        cells = cells.cells()
    base = cells.select("r", "c", F.col("z").isNotNull().cast("bigint").alias("n"), F.coalesce("z", F.lit(0.0)).alias("s"), F.coalesce(F.col("z") * F.col("z"), F.lit(0.0)).alias("q"))
    down = window_sums(base, grid, window, ["n", "s", "q"], edge)
    m = F.when(F.col("n") > 0, F.col("s") / F.col("n"))
    out = down.withColumn("m", m).withColumn("sd", F.when(F.col("n") > 0, F.sqrt(F.greatest(F.col("q") / F.col("n") - F.col("m") * F.col("m"), F.lit(0.0)))))
    return cells.select("r", "c", "z").join(out.select("r", "c", "m", "sd"), ["r", "c"])
