"""LAS point files (1.0 to 1.4, uncompressed) as DataFrames, read by ranges of points, and written one file a task.

LAZ, the compressed form, isn't read: its arithmetic coder can't be entered at a range, and no library for it is at hand. Such
files are told by their header and are an error.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Points that are decoded at once.
CHUNK = 1 << 18


@dataclass(frozen=True)
class Header:
    begin: int  # of the points
    record: int  # bytes of a point
    count: int
    scale: tuple[float, float, float]
    offset: tuple[float, float, float]


def header(data: bytes) -> Header:
    """From a file's first 375 bytes (or fewer, for versions before 1.4)."""
    if data[:4] != b"LASF" or len(data) < 227:
        raise ValueError("not a LAS file")
    kind = data[104]
    if kind & 0x80:
        raise ValueError("a LAZ file: compressed points aren't read")
    begin, record, count = struct.unpack_from("<I", data, 96)[0], struct.unpack_from("<H", data, 105)[0], struct.unpack_from("<I", data, 107)[0]
    if data[25] >= 4 and len(data) >= 255:
        count = struct.unpack_from("<Q", data, 247)[0] or count
    return Header(begin, record, count, struct.unpack_from("<3d", data, 131), struct.unpack_from("<3d", data, 155))


def decoded(head: Header, raw: bytes) -> np.ndarray:
    """(n, 3) doubles from whole point records."""
    whole = np.frombuffer(raw, np.uint8).reshape(-1, head.record)[:, :12]
    return np.ascontiguousarray(whole).view("<i4") * np.array(head.scale) + np.array(head.offset)


def encoded(points: np.ndarray, scale: float = 0.001) -> bytes:
    """A LAS 1.2 file, point format 0, of (n, 3) doubles; coordinates are rounded to the scale, origin at their minimum."""
    offset = points.min(axis=0) if len(points) else np.zeros(3)
    top = points.max(axis=0) if len(points) else np.zeros(3)
    head = bytearray(227)
    head[:4] = b"LASF"
    head[24:26] = bytes((1, 2))
    struct.pack_into("<H", head, 94, 227)
    struct.pack_into("<II", head, 96, 227, 0)
    head[104] = 0
    struct.pack_into("<HI", head, 105, 20, len(points))
    struct.pack_into("<6d", head, 131, scale, scale, scale, *offset)
    struct.pack_into("<6d", head, 179, top[0], offset[0], top[1], offset[1], top[2], offset[2])
    rows = np.zeros((len(points), 20), np.uint8)
    rows[:, :12] = np.rint((points - offset) / scale).astype("<i4").view(np.uint8).reshape(-1, 12)
    return bytes(head) + rows.tobytes()


def points(spark: SparkSession, paths: list[str], kind: str = "double", range_points: int = 1 << 20) -> DataFrame:
    """file, ord, x, y, z (``kind``: double or float) of LAS files; ord is a point's place in its file.

    Headers are read first; then every range of ``range_points`` points is a row of its own, read by offset, so one large file
    is many tasks. Paths are URIs that executors can open (file:, hdfs:, s3: ...). Files that don't exist are left out.
    """
    schema = "file string, ord long, x double, y double, z double"

    def heads(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for path in b.column(0).to_pylist():
                where, at = fs.FileSystem.from_uri(path)
                if where.get_file_info(at).type == fs.FileType.NotFound:
                    continue
                with where.open_input_file(at) as f:
                    head = header(f.read(375))
                rows += [(path, first, min(range_points, head.count - first)) for first in range(0, head.count, range_points)]
            cols = list(zip(*rows)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64())], ["file", "first", "n"])

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, first, n in zip(*(c.to_pylist() for c in b.columns)):
                where, at = fs.FileSystem.from_uri(path)
                with where.open_input_file(at) as f:
                    head = header(f.read(375))
                    for a in range(first, first + n, CHUNK):
                        k = min(CHUNK, first + n - a)
                        p = decoded(head, f.read_at(k * head.record, head.begin + a * head.record))
                        yield pa.RecordBatch.from_arrays([pa.array([path] * k), pa.array(np.arange(a, a + k)), *[pa.array(p[:, i]) for i in range(3)]], ["file", "ord", "x", "y", "z"])

    files = spark.createDataFrame([(p,) for p in paths], "file string").repartition(max(1, len(paths)))
    ranges = files.mapInArrow(heads, "file string, first long, n long")
    ranges = ranges.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    return ranges.mapInArrow(read, schema).withColumns({c: F.col(c).cast(kind) for c in "xyz"})


def cloud(spark: SparkSession, paths: list[str], kind: str = "float") -> DataFrame:
    """ord, x, y, z of several files as one cloud, ordinals running on in the files' order."""
    found = points(spark, paths, kind)
    sizes = {r["file"]: r["n"] for r in found.groupBy("file").agg(F.count("*").alias("n")).collect()}  # a row a file
    before, table = 0, []
    for p in paths:
        if p in sizes:
            table.append((p, before))
            before += sizes[p]
    starts = spark.createDataFrame(table, "file string, before long")
    return found.join(F.broadcast(starts), "file").select((F.col("ord") + F.col("before")).alias("ord"), "x", "y", "z")


def write(cloud_points: DataFrame, folder: str, scale: float = 0.001) -> DataFrame:
    """Write x, y, z as one LAS file a partition into ``folder`` (a URI); file and count of each that was written."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.stack([c.to_numpy(zero_copy_only=False).astype(float) for c in b.columns], axis=1) for b in batches if b.num_rows]
        if held:
            p = np.concatenate(held)
            where, base = fs.FileSystem.from_uri(folder)
            where.create_dir(base, recursive=True)
            name = f"part-{TaskContext.get().partitionId():05d}.las"
            part = f"{base}/{name}.{TaskContext.get().taskAttemptId()}.part"
            with where.open_output_stream(part) as f:
                f.write(encoded(p, scale))
            where.move(part, f"{base}/{name}")
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([len(p)], pa.int64())], ["file", "n"])

    return cloud_points.select(*[F.col(c).cast("double") for c in "xyz"]).mapInArrow(run, "file string, n long")
