"""Rasters as relations: cell(r, c, z) and the grid's placement."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Direction codes 0=S 1=SW 2=W 3=NW 4=N 5=NE 6=E 7=SE as row and column steps.
DR = (1, 1, 0, -1, -1, -1, 0, 1)
DC = (0, -1, -1, -1, 0, 1, 1, 1)
SQRT2 = 1.4142135623730951


@dataclass(frozen=True)
class GridMeta:
    """Rows, columns, and the geotransform: the upper left corner and the cell's size (dy < 0)."""

    rows: int
    cols: int
    x0: float = 0.0
    dx: float = 1.0
    y0: float = 0.0
    dy: float = -1.0
    epsg: int = 4326

    def node(self, r: Column, c: Column) -> Column:
        return r.cast("bigint") * self.cols + c

    def inside(self, r: Column, c: Column) -> Column:
        return (r >= 0) & (r < self.rows) & (c >= 0) & (c < self.cols)

    def step(self, k: int) -> float:
        return abs(self.dx) * (1.0 if k % 2 == 0 else SQRT2)


def grid_of(cells: DataFrame, **placement) -> GridMeta:
    top = cells.agg(F.max("r"), F.max("c")).first()
    return GridMeta(int(top[0]) + 1, int(top[1]) + 1, **placement)


def embedding_dem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embeddings table as an elevation raster: row vec_id, column array index."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").cast("int").alias("r"), F.posexplode("embedding").alias("c", "z"))
    return e.select("r", "c", F.col("z").cast("double").alias("z"))


def line_item_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lineitem table as a point cloud."""
    return as_points(spark.read.parquet(f"{sf_dir}/lineitem.parquet"))


def as_points(t: DataFrame) -> DataFrame:
    kind = F.when(F.col("l_returnflag") == "A", 2).when(F.col("l_returnflag") == "N", 1).otherwise(6)
    return t.select(F.col("l_partkey").cast("double").alias("x"), F.col("l_suppkey").cast("double").alias("y"), F.col("l_extendedprice").alias("z"), kind.alias("classification"))


def embedding_rows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, GridMeta]:
    """The same raster as rows(r, values), and its grid."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    top = e.agg(F.max("vec_id"), F.max(F.size("embedding"))).first()
    return e.select(F.col("vec_id").cast("int").alias("r"), F.col("embedding").alias("values")), GridMeta(int(top[0]) + 1, int(top[1]))
