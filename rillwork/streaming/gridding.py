"""Gridding of a growing point feed with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillwork.grid import GridMeta
from rillwork.operators.points import place
from rillwork.plans.store import shared_path


def grid_stream(points: DataFrame, grid: GridMeta) -> DataFrame:
    """A stream of points -> a stream of (r, c, low, high, mean, n); the state is one row a cell, whatever the feed's length."""
    return place(points, grid).groupBy("r", "c").agg(F.min("z").alias("low"), F.max("z").alias("high"), F.avg("z").alias("mean"), F.count("z").alias("n"))


def run_available(stream: DataFrame) -> DataFrame:
    """Works off what the source holds now; returns the table after it. Each batch writes its own folder, so a repeated batch does no harm."""
    spark = stream.sparkSession
    path = shared_path(spark, "grid-stream")
    query = (
        stream.writeStream.outputMode("complete").trigger(availableNow=True).option("checkpointLocation", f"{path}/state")
        .foreachBatch(lambda df, i: df.write.mode("overwrite").parquet(f"{path}/batch-{i}")).start()
    )
    query.awaitTermination()
    last = (query.lastProgress or {}).get("batchId")
    if last is None:
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).parquet(f"{path}/batch-{last}")
