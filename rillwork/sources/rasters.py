"""Stored rasters: tables of cells by tile, with their placement and tags beside them.

A raster is a folder: ``cells`` is Parquet, partitioned by tile row and sorted by tile, so that a reader of some
tiles skips the rest; ``meta`` is one row with the grid and the tags.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillwork.grid import GridMeta
from rillwork.plans.blocks import TILE

# How cells may pass water on, and the direction encodings that can be named (they are never converted).
ROUTINGS = ("d8", "dinf", "mfd_quinn", "mfd_holmgren", "rho8")
ENCODINGS = ("native", "taudem", "esri", "whitebox")


@dataclass(frozen=True)
class Raster:
    """cells(r, c, ...) with their grid and tags (kind, routing, encoding, threshold)."""

    cells: DataFrame
    grid: GridMeta
    tags: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        routing, encoding = self.tags.get("routing"), self.tags.get("encoding")
        if routing is not None and routing not in ROUTINGS:
            raise ValueError(f"routing is one of {ROUTINGS}")
        if encoding is not None and encoding not in ENCODINGS:
            raise ValueError(f"encoding is one of {ENCODINGS}")
        if self.tags.get("kind") == "streams" and routing not in (None, "d8", "rho8"):
            raise TypeError("streams need a routing with one receiver a cell")

    def tagged(self, **tags) -> Raster:
        return Raster(self.cells, self.grid, self.tags | tags)


def write_raster(raster: Raster, path: str, tile: int = TILE) -> None:
    at = lambda x: F.floor(F.col(x) / tile).cast("int")
    placed = raster.cells.withColumn("tile_row", at("r")).withColumn("tile_col", at("c"))
    sorted_ = placed.repartitionByRange("tile_row", "tile_col").sortWithinPartitions("tile_row", "tile_col", "r", "c")
    sorted_.write.partitionBy("tile_row").parquet(f"{path}/cells")
    spark = raster.cells.sparkSession
    spark.createDataFrame([(json.dumps(asdict(raster.grid)), json.dumps(raster.tags))], "grid string, tags string").coalesce(1).write.parquet(f"{path}/meta")


def read_raster(spark: SparkSession, path: str, kind: str | None = None, required: tuple[str, ...] = (), **tags) -> Raster:
    """The stored raster; given tags win over stored ones, and a required tag that neither has is an error."""
    meta = spark.read.parquet(f"{path}/meta").first()
    merged = json.loads(meta["tags"]) | {k: v for k, v in tags.items() if v is not None} | ({"kind": kind} if kind else {})
    for name in required:
        if merged.get(name) is None:
            raise ValueError(f"{name} is neither given nor stored")
    return Raster(spark.read.parquet(f"{path}/cells").drop("tile_row", "tile_col"), GridMeta(**json.loads(meta["grid"])), merged)


def open_flow_direction(spark: SparkSession, path: str, routing: str | None = None, encoding: str | None = None) -> Raster:
    out = read_raster(spark, path, "flow_direction", ("routing",), routing=routing, encoding=encoding)
    return out if out.tags.get("encoding") else out.tagged(encoding="native")


def open_accumulation(spark: SparkSession, path: str, routing: str | None = None) -> Raster:
    return read_raster(spark, path, "accumulation", ("routing",), routing=routing)


def open_streams(spark: SparkSession, path: str, threshold: float | None = None, routing: str | None = None) -> Raster:
    out = read_raster(spark, path, "streams", ("threshold", "routing"), threshold=threshold, routing=routing)
    return out.tagged(threshold=float(out.tags["threshold"]))
