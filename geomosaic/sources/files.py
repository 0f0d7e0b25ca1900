"""Stage files as DataFrames: world files, tile, detection and object records, run manifests, point files.

Everything is read by Spark's readers, so paths may lie in any store that Spark knows. Defaults are applied here, once.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geomosaic.functions.geo import Geotransform

PATCH = "patch_id string, grid_index array<int>, pixel_origin array<int>, pixel_size int, world_origin array<double>, world_bounds array<double>, resolution double, content_ratio double, black_ratio double, status string"
QTILE = "tile_id string, bounds_m array<double>, edge_density double, content_ratio double, pixel_region array<int>, skipped boolean, skip_reason string"
DETECTION = "score double, area_m2 double, equivalent_diameter_m double, centroid_world array<double>, bbox_world array<double>, pixel_origin array<int>, rle_mask struct<size:array<int>,counts:array<int>>, source_patch_id string"
STONE = "stone_id string, merge_method string, source_detection_count int, source_patches_span int, score_mean double, score_max double, bbox_world array<double>, detection_indices array<int>"


def world_file(spark: SparkSession, path: str) -> Geotransform:
    """Six numbers, one to a line: pixel width, two rotations, pixel height, origin x and y. Blank lines don't count; any other
    count of numbers is an error."""
    lines = [x.strip() for x in spark.read.text(path, wholetext=True).head()[0].splitlines()]
    values = [float(x) for x in lines if x]
    if len(values) != 6:
        raise ValueError(f"{path}: a world file has six numbers, not {len(values)}")
    pixel_w, rot_y, rot_x, pixel_h, x, y = values
    return Geotransform(x, pixel_w, rot_x, y, rot_y, pixel_h)


def _listed(spark: SparkSession, path: str, field: str, schema: str) -> DataFrame:
    whole = spark.read.schema(f"{field} array<struct<{_as_struct(schema)}>>").option("multiLine", True).json(path)
    return whole.select(F.posexplode(field).alias("ord", "r")).select(F.col("ord").cast("long"), "r.*")


def _as_struct(schema: str) -> str:
    """Column definitions (``a int, b array<int>``) as fields of a struct type."""
    out, depth, word = [], 0, ""
    for c in schema + ",":
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            name, kind = word.strip().split(" ", 1)
            out.append(f"{name}:{kind.strip()}")
            word = ""
        else:
            word += c
    return ",".join(out)


def patches(spark: SparkSession, path: str) -> DataFrame:
    """The tiles of a sliding-window report; a missing status counts as kept."""
    return _listed(spark, path, "patches", PATCH).withColumn("status", F.coalesce("status", F.lit("kept")))


def quadtree_tiles(spark: SparkSession, path: str) -> DataFrame:
    """The tiles of a quadtree report; a missing skip counts as false."""
    return _listed(spark, path, "tiles", QTILE).withColumn("skipped", F.coalesce("skipped", F.lit(False)))


def stones(spark: SparkSession, path: str) -> DataFrame:
    return _listed(spark, path, "stones", STONE)


def detections(spark: SparkSession, path: str) -> DataFrame:
    """A JSON list; det_idx is a record's place in it."""
    text = spark.read.text(path, wholetext=True)
    rows = F.from_json("value", f"array<struct<{_as_struct(DETECTION)}>>")
    return text.select(F.posexplode(rows).alias("det_idx", "r")).select(F.col("det_idx").cast("long"), "r.*").withColumn("source_patch_id", F.coalesce("source_patch_id", F.lit("")))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """method, stats (JSON text): one row for each method of a run."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", "map<string,string>")).alias("method", "stats"))


_PLY = {"float": "f4", "float32": "f4", "double": "f8", "float64": "f8", "char": "i1", "int8": "i1", "uchar": "u1", "uint8": "u1", "short": "i2", "int16": "i2", "ushort": "u2", "uint16": "u2", "int": "i4", "int32": "i4", "uint": "u4", "uint32": "u4"}


def parse_ply(data: bytes) -> np.ndarray:
    """x, y, z of the vertices (n, 3); ASCII or binary, other properties of a vertex are skipped."""
    head, found, body = data.partition(b"end_header\n")
    lines = [x.split() for x in head.decode("ascii", "replace").splitlines()]
    if not found or not lines or lines[0] != ["ply"]:
        raise ValueError("not a PLY file")
    form = next(x[1] for x in lines if x and x[0] == "format")
    n, fields, inside = 0, [], False
    for x in lines:
        if x and x[0] == "element":
            inside = x[1] == "vertex"
            n = int(x[2]) if inside else n
        elif x and x[0] == "property" and inside:
            fields.append((x[2], _PLY[x[1]]))
    if form == "ascii":
        rows = [r.split() for r in body.decode("ascii").splitlines()[:n]]
        at = [[f for f, _ in fields].index(c) for c in "xyz"]
        return np.array([[float(r[i]) for i in at] for r in rows]).reshape(-1, 3)
    order = "<" if form == "binary_little_endian" else ">"
    v = np.frombuffer(body, np.dtype([(f, order + k) for f, k in fields]), n)
    return np.stack([v[c].astype(float) for c in "xyz"], axis=1)


def ply_points(spark: SparkSession, path: str) -> DataFrame:
    """file, ord, x, y, z of one PLY file for each object. Each file is read whole by one task."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                p = parse_ply(data)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(p), pa.string()), pa.array(np.arange(len(p))), *[pa.array(p[:, i]) for i in range(3)]], ["file", "ord", "x", "y", "z"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, "file string, ord long, x double, y double, z double")
