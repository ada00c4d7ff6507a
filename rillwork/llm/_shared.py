"""What the operators of this subpackage share: scratch tables, Arrow row mapping, word splitting."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of bytes other than the six ASCII white-space characters.
WORD = re.compile(rb"[^\x20\x09-\x0d]+")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the cluster shares (``spark.checkpoint.dir``).

    Where the setting is absent, a temporary folder is taken on a local master only: on a
    cluster the executors would not see it, so there the call fails.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="rillwork-")
    return f"{base.rstrip('/')}/rillwork/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: cuts lineage, survives executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Most bitmaps of 4 KB, each of 32768 neighbouring ids, that are broadcast.
BITMAPS = 1 << 13


def by_bitmaps(docs: DataFrame, ids: DataFrame) -> DataFrame | None:
    """The rows of docs whose doc_id is in ids(doc_id: bigint), without a shuffle of docs; None where ids are too sparse for it.

    Ids go to the rows as bitmaps, a bit an id where ids are dense; too sparse are those that take more than BITMAPS bitmaps.
    """
    block, bit = F.bitmap_bucket_number, F.bitmap_bit_position
    if ids.agg(F.count_distinct(block("doc_id"))).first()[0] > BITMAPS:
        return None
    maps = materialize(ids.groupBy(block("doc_id").alias("__block")).agg(F.bitmap_construct_agg(bit("doc_id")).alias("__bits")), "bitmaps")
    at = docs["doc_id"].cast("bigint")
    byte = F.conv(F.hex(F.substring(maps["__bits"], (F.floor(bit(at) / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return docs.join(F.broadcast(maps), (block(at) == maps["__block"]) & (F.getbit(byte, F.pmod(bit(at), F.lit(8)).cast("int")) == 1), "left_semi")


def give_back() -> None:
    """Freed memory goes back to the system (where the C library can), so that a Python worker that waits for its next task holds little."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


#: A step gets at most so many bytes of Arrow data at once (or one row, if that is larger).
STEP_BYTES = 2 << 20


def pieces(batch: pa.RecordBatch, limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch cut into runs of rows of at most ``limit`` bytes, or one row: bounds what a step holds at once."""
    if batch.num_rows > 1 and batch.nbytes > limit:
        half = batch.num_rows // 2
        yield from pieces(batch.slice(0, half), limit)
        yield from pieces(batch.slice(half), limit)
    elif batch.num_rows:
        yield batch


def map_batches(df: DataFrame, make: Callable[[], Callable[[dict], dict]], schema: str, limit: int = STEP_BYTES) -> DataFrame:
    """Apply a function of columns to columns over Arrow batches.

    ``make`` runs once per task (load models there) and returns the function; it gets a dict of
    Arrow arrays and returns a dict of lists, arrays or Arrow arrays, one per field of ``schema``.
    A batch comes in pieces of ``limit`` bytes, whose results leave before the next piece is begun.
    """
    target = pa_schema(df.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            for part in pieces(batch, limit):
                yield as_batch(step({n: part.column(i) for i, n in enumerate(part.schema.names)}), target)
            give_back()
        del step
        give_back()

    return df.mapInArrow(run, schema)


def map_groups(df: DataFrame, keys: list[str], step: Callable[[dict], dict], schema: str) -> DataFrame:
    """Apply ``step`` to runs of whole groups. ``df`` must be partitioned and sorted by ``keys``.

    A group that spans Arrow batches is held until it ends, so callers bound their groups' sizes.
    """
    target = pa_schema(df.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            starts = group_starts([batch.column(batch.schema.get_field_index(k)) for k in keys])
            joined = held and all(held[-1].column(i)[-1] == batch.column(i)[0] for i in map(batch.schema.get_field_index, keys))
            last = int(starts[-1])
            if joined and last == 0:
                held.append(batch)
                continue
            ready = [*held, batch.slice(0, last)] if last else held
            if ready:
                yield as_batch(step(columns(ready)), target)
            held = [batch.slice(last)]
        if held:
            yield as_batch(step(columns(held)), target)
        held.clear()
        give_back()

    return df.mapInArrow(run, schema)


def columns(batches: list[pa.RecordBatch]) -> dict:
    table = pa.Table.from_batches(batches).combine_chunks()
    return {n: table.column(n).combine_chunks() for n in table.column_names}


def group_starts(keys: list[pa.Array]) -> np.ndarray:
    """The first index of each run of equal keys (integers without nulls)."""
    n = len(keys[0])
    new = np.zeros(n, dtype=bool)
    new[0] = True
    for k in keys:
        v = np.asarray(k)
        new[1:] |= v[1:] != v[:-1]
    return np.flatnonzero(new)


def pa_schema(spark: SparkSession, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


def as_batch(out: dict, target: pa.Schema) -> pa.RecordBatch:
    arrays = []
    for f in target:
        v = out[f.name]
        v = v.combine_chunks() if isinstance(v, pa.ChunkedArray) else v
        arrays.append(v.cast(f.type) if isinstance(v, pa.Array) else pa.array(v, type=f.type))
    return pa.RecordBatch.from_arrays(arrays, schema=target)


def utf8(texts: pa.Array) -> list[bytes]:
    """The texts' UTF-8 bytes; a null text is empty."""
    return [b"" if t is None else t for t in texts.cast(pa.binary()).to_pylist()]


def local_forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest node that the links a-b reach."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return label


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_default_columns(df: DataFrame, **types: str) -> DataFrame:
    """Only the named columns, cast; a missing one is null."""
    return df.select(*(F.col(c).cast(t).alias(c) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in types.items()))
