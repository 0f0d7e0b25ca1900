"""TIFF rasters by strips or tiles: metadata, blocks of pixels, down-scaled reads.

8-bit samples, one or several bands in chunky order, uncompressed or deflate; strips or tiles are read by range, each by
whichever task holds its row. Other compressions and big TIFFs are an error that names them.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geomosaic.functions.geo import Geotransform

_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 12: 8}


@dataclass(frozen=True)
class Layout:
    width: int
    height: int
    bands: int
    block_width: int
    block_height: int
    deflate: bool
    predictor: bool
    places: tuple[tuple[int, int], ...]  # offset and bytes of each block, row by row


def layout(read) -> Layout:
    """read(offset, n) gives bytes of the file."""
    head = read(0, 8)
    order = {b"II": "<", b"MM": ">"}.get(head[:2])
    if order is None or struct.unpack(order + "H", head[2:4])[0] != 42:
        raise ValueError("not a TIFF file (or a big TIFF)")
    at = struct.unpack(order + "I", head[4:8])[0]
    n = struct.unpack(order + "H", read(at, 2))[0]
    raw, tags = read(at + 2, 12 * n), {}
    for i in range(n):
        tag, kind, count = struct.unpack_from(order + "HHI", raw, 12 * i)
        size = _SIZES.get(kind, 0) * count
        data = raw[12 * i + 8 : 12 * i + 12] if size <= 4 else read(struct.unpack_from(order + "I", raw, 12 * i + 8)[0], size)
        if kind in (3, 4):
            tags[tag] = struct.unpack(f"{order}{count}{'H' if kind == 3 else 'I'}", data[:size])
    one = lambda tag, default: tags.get(tag, (default,))[0]
    width, height, bands, compression = one(256, 0), one(257, 0), one(277, 1), one(259, 1)
    if set(tags.get(258, (1,))) != {8} or one(284, 1) != 1:
        raise ValueError("only 8-bit samples in chunky order are read")
    if compression not in (1, 8, 32946):
        raise ValueError(f"compression {compression} isn't read")
    if 322 in tags:
        bw, bh, offsets, sizes = one(322, 0), one(323, 0), tags[324], tags[325]
    else:
        bw, bh, offsets, sizes = width, min(height, one(278, height)), tags[273], tags[279]
    return Layout(width, height, bands, bw, bh, compression != 1, one(317, 1) == 2, tuple(zip(offsets, sizes)))


def pixels_of(shape: Layout, which: int, data: bytes) -> tuple[int, int, np.ndarray]:
    """x, y and the (height, width, bands) pixels of a block, without what reaches beyond the raster."""
    across = -(-shape.width // shape.block_width)
    x, y = which % across * shape.block_width, which // across * shape.block_height
    raw = zlib.decompress(data) if shape.deflate else data
    rows = len(raw) // (shape.block_width * shape.bands)
    a = np.frombuffer(raw, np.uint8, rows * shape.block_width * shape.bands).reshape(rows, shape.block_width, shape.bands)
    if shape.predictor:
        a = np.cumsum(a, axis=1, dtype=np.uint8)
    return x, y, a[: shape.height - y, : shape.width - x]


def encoded(image: np.ndarray, tile: int = 64, deflate: bool = True) -> bytes:
    """A tiled TIFF of a (height, width, bands) array of bytes; ``tile`` is a multiple of 16."""
    h, w, bands = image.shape
    blocks = []
    for y in range(0, h, tile):
        for x in range(0, w, tile):
            block = np.zeros((tile, tile, bands), np.uint8)
            part = image[y : y + tile, x : x + tile]
            block[: part.shape[0], : part.shape[1]] = part
            blocks.append(zlib.compress(block.tobytes(), 6) if deflate else block.tobytes())
    body, offsets = bytearray(b"II*\0\0\0\0\0"), []
    for b in blocks:
        offsets.append(len(body))
        body += b
    lists = []
    for values, kind in (((8,) * bands, "H"), (offsets, "I"), ([len(b) for b in blocks], "I")):
        data = struct.pack(f"<{len(values)}{kind}", *values)
        lists.append((len(values), struct.unpack("<I", data.ljust(4, b"\0"))[0] if len(data) <= 4 else len(body)))
        body += data if len(data) > 4 else b""
    struct.pack_into("<I", body, 4, len(body))
    one = lambda tag, kind, v: struct.pack("<HHII", tag, kind, 1, v)
    tags = [one(256, 4, w), one(257, 4, h), struct.pack("<HHII", 258, 3, *lists[0]), one(259, 3, 8 if deflate else 1), one(262, 3, 1 if bands == 1 else 2), one(277, 3, bands), one(284, 3, 1), one(322, 4, tile), one(323, 4, tile), struct.pack("<HHII", 324, 4, *lists[1]), struct.pack("<HHII", 325, 4, *lists[2])]
    return bytes(body) + struct.pack("<H", len(tags)) + b"".join(tags) + b"\0\0\0\0"


def _open(path: str):
    where, at = fs.FileSystem.from_uri(path)
    f = where.open_input_file(at)
    return f, lambda offset, n: f.read_at(n, offset)


def info(path: str) -> Layout:
    f, read = _open(path)
    with f:
        return layout(read)


def metadata(spark: SparkSession, path: str, gt: Geotransform) -> DataFrame:
    """One row: width, height, bands, resolution and the world bounds of the corners."""
    shape = info(path)
    return spark.createDataFrame([(shape.width, shape.height, shape.bands, gt.resolution, *gt.bounds(shape.width, shape.height))], "width int, height int, bands int, resolution double, xmin double, ymin double, xmax double, ymax double")


def blocks(spark: SparkSession, path: str) -> DataFrame:
    """x, y, width, height, bands, data (bytes, row-major, bands together) of each strip or tile, a range read each."""
    n = len(info(path).places)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f, read = _open(path)
        with f:
            shape = layout(read)
            for b in batches:
                for which in b.column(0).to_pylist():
                    x, y, a = pixels_of(shape, which, read(*shape.places[which]))
                    yield pa.RecordBatch.from_arrays([*[pa.array([v], pa.int32()) for v in (x, y, a.shape[1], a.shape[0], a.shape[2])], pa.array([np.ascontiguousarray(a).tobytes()], pa.binary())], ["x", "y", "width", "height", "bands", "data"])

    return spark.range(n).mapInArrow(run, "x int, y int, width int, height int, bands int, data binary")


def pixels(found: DataFrame) -> DataFrame:
    """px, py and the array ``bands`` of every pixel of ``blocks``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x, y, w, h, k, data in zip(*(c.to_pylist() for c in b.columns)):
                a = np.frombuffer(data, np.uint8).reshape(h * w, k).astype(np.int32)
                at = np.arange(h * w)
                yield pa.RecordBatch.from_arrays([pa.array(x + at % w), pa.array(y + at // w), pa.array(list(a), pa.list_(pa.int32()))], ["px", "py", "bands"])

    return found.mapInArrow(run, "px long, py long, bands array<int>")


def downscaled(spark: SparkSession, path: str, max_side: int = 8000) -> tuple[DataFrame, float]:
    """px, py, bands (means of squares of pixels) on an image whose longer side is at most ``max_side``, and its scale: one over
    a whole number, never above 1."""
    shape = info(path)
    k = max(1, -(-max(shape.width, shape.height) // max_side))
    cells = pixels(blocks(spark, path)).groupBy(F.floor(F.col("px") / k).alias("px"), F.floor(F.col("py") / k).alias("py"))
    means = [F.avg(F.get("bands", F.lit(i))) for i in range(shape.bands)]
    return cells.agg(F.array(*means).alias("bands")), 1.0 / k
