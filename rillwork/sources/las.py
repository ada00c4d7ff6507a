"""LAS point files as tables, and tables as LAS files."""

from __future__ import annotations

import operator
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    IsNotNull,
    LessThan,
    LessThanOrEqual,
    WriterCommitMessage,
)

# Byte offsets of the public LAS header and of the fields of a point record.
OFFSET_TO_POINTS, FORMAT, RECORD_LENGTH, LEGACY_COUNT, SCALES, COUNT_14 = 96, 104, 105, 107, 131, 247
# The record that holds a coordinate system as text.
WKT_USER, WKT_RECORD = b"LASF_Projection", 2112
#: Points that a task's batch, and a row of work, hold.
POINTS_A_BATCH, POINTS_A_RANGE = 100_000, 1_000_000
HEADER_14, RECORD_6 = 375, 30
OPTIONAL = ("intensity", "classification", "return_number")
POINTS = "x double, y double, z double, intensity int, classification short, return_number short"


def _open(path: str):
    """A random-access file on any store that pyarrow reads."""
    from pyarrow import fs

    if "://" in path:
        system, name = fs.FileSystem.from_uri(path)
        return system.open_input_file(name)
    return fs.LocalFileSystem().open_input_file(path.removeprefix("file:"))


def _layout(path: str) -> tuple[int, int, int, int, tuple[float, ...]]:
    """Offset of the first record, its length, its format, the number of points, and scales and offsets."""
    with _open(path) as f:
        head = f.read(HEADER_14)
    if head[:4] != b"LASF":
        raise ValueError("not a LAS file")
    (start,), kind = struct.unpack_from("<I", head, OFFSET_TO_POINTS), head[FORMAT]
    if kind & 0x80:
        raise ValueError("compressed point records (LAZ) are not read")
    (length,), (count,) = struct.unpack_from("<H", head, RECORD_LENGTH), struct.unpack_from("<I", head, LEGACY_COUNT)
    if head[25] >= 4:
        (count,) = struct.unpack_from("<Q", head, COUNT_14)
    return start, length, kind, count, struct.unpack_from("<6d", head, SCALES)


def _points(path: str, first: int, last: int):
    start, length, kind, _, (sx, sy, sz, ox, oy, oz) = _layout(path)
    new = kind >= 6
    record = np.dtype({"names": ["x", "y", "z", "intensity", "returns", "classification"], "formats": ["<i4", "<i4", "<i4", "<u2", "u1", "u1"], "offsets": [0, 4, 8, 12, 14, 16 if new else 15], "itemsize": length})
    with _open(path) as f:
        f.seek(start + first * length)
        for at in range(first, last, POINTS_A_BATCH):
            n = min(POINTS_A_BATCH, last - at)
            p = np.frombuffer(f.read(n * length), record, n)
            yield pd.DataFrame({
                "x": p["x"] * sx + ox, "y": p["y"] * sy + oy, "z": p["z"] * sz + oz, "intensity": p["intensity"].astype("i4"),
                "classification": (p["classification"] & (0xFF if new else 0x1F)).astype("i2"), "return_number": (p["returns"] & (0x0F if new else 0x07)).astype("i2"),
            })


def read_las(spark: SparkSession, path: str) -> DataFrame:
    """points(x, y, z, intensity, classification, return_number) of all LAS files under a path.

    Headers give ranges of POINTS_A_RANGE records; a task seeks to its ranges, so a file of any size is split.
    """

    def ranges(frames):
        for pdf in frames:
            for p in pdf.path:
                count = _layout(p)[3]
                first = np.arange(0, count, POINTS_A_RANGE)
                yield pd.DataFrame({"path": p, "first": first, "last": np.minimum(first + POINTS_A_RANGE, count)})

    def parse(frames):
        for pdf in frames:
            for p, first, last in zip(pdf.path, pdf["first"], pdf["last"], strict=True):
                yield from _points(p, first, last)

    # only the paths are read here, not the files
    work = spark.read.format("binaryFile").load(path).select("path").mapInPandas(ranges, "path string, first bigint, last bigint")
    return work.repartition(F.col("path"), F.col("first")).mapInPandas(parse, POINTS)


def las_crs(path: str) -> str | None:
    """The coordinate system that a file's header names as text, if it does."""
    with _open(path) as f:
        head = f.read(HEADER_14)
        (size,), (n,) = struct.unpack_from("<H", head, 94), struct.unpack_from("<I", head, 100)
        f.seek(size)
        for _ in range(n):
            record = f.read(54)
            (kind, length) = struct.unpack_from("<HH", record, 18)
            body = f.read(length)
            if record[2:18].rstrip(b"\0") == WKT_USER and kind == WKT_RECORD:
                return body.rstrip(b"\0").decode()
    return None


def _crs_record(crs: str | None) -> bytes:
    """The variable-length record of a coordinate system as text; nothing without one."""
    if crs is None:
        return b""
    body = crs.encode() + b"\0"
    return struct.pack("<H16sHH32s", 0, WKT_USER, WKT_RECORD, len(body), b"") + body


def _write_part(system, name: str, batches: Iterator[pa.RecordBatch], scale: float, crs: str | None) -> int:
    """One LAS 1.4 file of format 6 from batches of points; none if there are no points. Records are spooled first, since the header has their count."""
    record = np.dtype({"names": ["x", "y", "z", "intensity", "return_number", "classification"], "formats": ["<i4", "<i4", "<i4", "<u2", "u1", "u1"], "offsets": [0, 4, 8, 12, 14, 16], "itemsize": RECORD_6})
    count, low, high, returns, origin = 0, np.full(3, np.inf), np.full(3, -np.inf), np.zeros(16, np.int64), None
    body = f"{name}.body"
    try:
        with system.open_output_stream(body) as f:
            for batch in batches:
                if not batch.num_rows:
                    continue
                column = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
                xyz = np.stack([column[k].cast(pa.float64()).to_numpy(zero_copy_only=False) for k in "xyz"], axis=1)
                if np.isnan(xyz).any():
                    raise ValueError("a point has no place")
                origin = np.floor(xyz[0]) if origin is None else origin
                p = np.zeros(len(xyz), record)
                for i, k in enumerate("xyz"):
                    p[k] = np.rint((xyz[:, i] - origin[i]) / scale)
                for k in OPTIONAL:
                    if k in column:
                        p[k] = column[k].fill_null(0).to_numpy(zero_copy_only=False)
                count, low, high = count + len(p), np.minimum(low, xyz.min(0)), np.maximum(high, xyz.max(0))
                returns += np.bincount(p["return_number"] & 15, minlength=16)
                f.write(p.tobytes())
        if count:
            head, named = bytearray(HEADER_14), _crs_record(crs)
            head[:4], head[24], head[25], head[FORMAT] = b"LASF", 1, 4, 6
            struct.pack_into("<H", head, 6, 16 if named else 0)
            struct.pack_into("<HII", head, 94, HEADER_14, HEADER_14 + len(named), 1 if named else 0)
            struct.pack_into("<H", head, RECORD_LENGTH, RECORD_6)
            struct.pack_into("<12d", head, SCALES, scale, scale, scale, *origin, *(v for pair in zip(high, low, strict=True) for v in pair))
            struct.pack_into("<Q15Q", head, COUNT_14, count, *returns[1:].tolist())
            with system.open_output_stream(name) as f, system.open_input_stream(body) as g:
                f.write(bytes(head) + named)
                while part := g.read(1 << 22):
                    f.write(part)
    finally:
        system.delete_file(body)
    return count


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


def _las_files(system, folder: str) -> list[str]:
    """A file itself, or a folder's LAS files, hidden and temporary ones left out."""
    from pyarrow import fs

    info = system.get_file_info(folder)
    if info.type == fs.FileType.File:
        return [folder]
    found = system.get_file_info(fs.FileSelector(folder, allow_not_found=True))
    return sorted(f.path for f in found if f.type == fs.FileType.File and f.path.endswith(".las") and not f.base_name.startswith(("_", ".")))


@dataclass
class _Range(InputPartition):
    path: str
    first: int
    last: int


class LasReader(DataSourceReader):
    """Record ranges of files as partitions; comparisons of one column with a value are made on the records as they are read."""

    def __init__(self, path: str) -> None:
        self.path, self.tests = path, []

    def pushFilters(self, filters):  # noqa: N802
        kinds = {EqualTo: "eq", GreaterThan: "gt", GreaterThanOrEqual: "ge", LessThan: "lt", LessThanOrEqual: "le", In: "in"}
        for f in filters:
            if type(f) in kinds and len(f.attribute) == 1:
                self.tests.append((kinds[type(f)], f.attribute[0], f.value))
            elif not isinstance(f, IsNotNull):  # no column of a file has nulls
                yield f

    def partitions(self):
        system, folder = _store(self.path)
        prefix = self.path[: self.path.index("://") + 3] if "://" in self.path else ""
        out = []
        for name in _las_files(system, folder):
            count = _layout(prefix + name)[3]
            out += [_Range(prefix + name, i, min(i + POINTS_A_RANGE, count)) for i in range(0, count, POINTS_A_RANGE)]
        return out or [_Range("", 0, 0)]

    def read(self, partition):
        target = pa.schema([(n, t) for n, t in (("x", pa.float64()), ("y", pa.float64()), ("z", pa.float64()), ("intensity", pa.int32()), ("classification", pa.int16()), ("return_number", pa.int16()))])
        for frame in _points(partition.path, partition.first, partition.last) if partition.path else []:
            keep = np.ones(len(frame), bool)
            for kind, name, value in self.tests:
                v = frame[name].to_numpy()
                keep &= np.isin(v, [x for x in value if x is not None]) if kind == "in" else getattr(operator, kind)(v, value)
            yield pa.RecordBatch.from_pandas(frame[keep], schema=target, preserve_index=False)


@dataclass
class _Written(WriterCommitMessage):
    draft: str
    name: str
    points: int


class LasWriter(DataSourceArrowWriter):
    """Tasks write drafts into a hidden folder; the commit moves them into place, an abort removes them."""

    def __init__(self, path: str, scale: float, crs: str | None, overwrite: bool) -> None:
        self.path, self.scale, self.crs, self.overwrite, self.job = path, scale, crs, overwrite, uuid.uuid4().hex
        system, folder = _store(path)
        self.before = _las_files(system, folder) if overwrite else []

    def write(self, iterator):
        from pyspark import TaskContext

        system, folder = _store(self.path)
        context = TaskContext.get()
        system.create_dir(f"{folder}/_drafts-{self.job}", recursive=True)
        draft = f"{folder}/_drafts-{self.job}/{context.partitionId():06d}-{context.taskAttemptId()}"
        return _Written(draft, f"{folder}/part-{context.partitionId():06d}-{self.job}.las", _write_part(system, draft, iterator, self.scale, self.crs))

    def commit(self, messages):
        system, _ = _store(self.path)
        for m in messages:
            if m and m.points:
                system.move(m.draft, m.name)
        for old in self.before:
            system.delete_file(old)
        self.abort(messages)

    def abort(self, messages):
        from pyarrow import fs

        system, folder = _store(self.path)
        if system.get_file_info(f"{folder}/_drafts-{self.job}").type == fs.FileType.Directory:
            system.delete_dir(f"{folder}/_drafts-{self.job}")


class LasSource(DataSource):
    """``spark.read.format("las")`` and ``df.write.format("las")``; options: path, and for writing scale and crs (well-known text)."""

    @classmethod
    def name(cls) -> str:
        return "las"

    def schema(self) -> str:
        return POINTS

    def reader(self, schema):
        return LasReader(self.options["path"])

    def writer(self, schema, overwrite):
        if not {"x", "y", "z"} <= set(schema.fieldNames()):
            raise ValueError("points have x, y and z")
        return LasWriter(self.options["path"], float(self.options.get("scale", 0.001)), self.options.get("crs"), overwrite)


def register(spark: SparkSession) -> None:
    """Make the format ``las`` known to the session, with filters pushed down to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(LasSource)


def write_las(points: DataFrame, path: str, scale: float = 0.001, crs: str | None = None) -> None:
    """points(x, y, z and, if there, intensity, classification, return_number) as LAS 1.4 files of format 6, one a partition that has points.

    ``crs`` is well-known text, which each file's header then names. The folder's earlier LAS files are replaced once all
    are written; a job that fails leaves them as they are, and nothing of its own.
    """
    register(points.sparkSession)
    optional = [c for c in OPTIONAL if c in points.columns]
    out = points.select("x", "y", "z", *optional).write.format("las").mode("overwrite").option("scale", str(scale))
    (out if crs is None else out.option("crs", crs)).save(path)
