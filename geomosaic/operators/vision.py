"""Raster operators that need neighbourhoods: edge maps by blocks with a halo, and mask outlines."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StructField, StructType

from geomosaic.operators.graph import connected_components

HALO = 2


def gradients(gray: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sobel derivatives in x and y; the border is repeated."""
    g = np.pad(gray.astype(np.int64), 1, mode="edge")
    row = g[:-2] + 2 * g[1:-1] + g[2:]
    col = g[:, :-2] + 2 * g[:, 1:-1] + g[:, 2:]
    return row[:, 2:] - row[:, :-2], col[2:] - col[:-2]


def ridge(gray: np.ndarray) -> np.ndarray:
    """Gradient magnitude (sum of absolute derivatives) where it is a maximum across the edge, else 0."""
    gx, gy = gradients(gray)
    mag = np.abs(gx) + np.abs(gy)
    m = np.pad(mag, 1)
    at = lambda dy, dx: m[1 + dy : m.shape[0] - 1 + dy, 1 + dx : m.shape[1] - 1 + dx]
    steep = np.abs(gy) / np.maximum(np.abs(gx), 1e-9)
    flat, tall = steep < np.tan(np.pi / 8), steep > np.tan(3 * np.pi / 8)
    falling = (gx >= 0) != (gy >= 0)
    one = np.where(flat, at(0, -1), np.where(tall, at(-1, 0), np.where(falling, at(-1, 1), at(-1, -1))))
    two = np.where(flat, at(0, 1), np.where(tall, at(1, 0), np.where(falling, at(1, -1), at(1, 1))))
    return np.where((mag > one) & (mag >= two), mag, 0)


def edge_map(spark: SparkSession, pixels: DataFrame, width: int, height: int, low: int = 30, high: int = 90, block: int = 256) -> DataFrame:
    """px, py, edge (0 or 1) for every pixel (px, py, v): a Canny edge detector over blocks.

    Each block gets a halo of two pixels, which makes derivatives and thinning exact. Weak pixels are edges if they hang on a
    strong one; that relation crosses blocks, so neighbouring weak pixels are joined and their components resolved globally.
    """
    near = lambda c, n: F.array_distinct(F.filter(F.transform(F.array(F.lit(-HALO), F.lit(0), F.lit(HALO)), lambda d: F.floor((F.col(c) + d) / F.lit(block))), lambda b: (b >= 0) & (b * block < n)))
    spread = pixels.select("px", "py", "v").withColumn("bx", F.explode(near("px", width))).withColumn("by", F.explode(near("py", height)))

    def thin(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        bx, by = int(key[0]), int(key[1])
        x0, y0 = max(0, bx * block - HALO), max(0, by * block - HALO)
        x1, y1 = min(width, (bx + 1) * block + HALO), min(height, (by + 1) * block + HALO)
        a = np.zeros((y1 - y0, x1 - x0), np.int64)
        a[pdf["py"].to_numpy() - y0, pdf["px"].to_numpy() - x0] = pdf["v"].to_numpy()
        m = ridge(a)
        ys, xs = np.nonzero(m > low)
        keep = ((xs + x0) // block == bx) & ((ys + y0) // block == by)
        ys, xs = ys[keep], xs[keep]
        return pd.DataFrame({"px": xs + x0, "py": ys + y0, "strong": m[ys, xs] > high})

    weak = spread.groupBy("bx", "by").applyInPandas(thin, "px long, py long, strong boolean")
    from geomosaic import session

    weak = session.written(spark, weak.withColumn("id", F.col("py") * width + F.col("px")), "ridges")
    ahead = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in ((1, 0), (-1, 1), (0, 1), (1, 1))])
    steps = weak.select("id", "px", "py", F.explode(ahead).alias("d")).select("id", (F.col("px") + F.col("d.dx")).alias("px"), (F.col("py") + F.col("d.dy")).alias("py"))
    links = steps.join(weak.select("px", "py", F.col("id").alias("dst")), ["px", "py"]).select(F.col("id").alias("src"), "dst")
    group = weak.join(connected_components(spark, links).withColumnRenamed("node", "id"), "id", "left").select("px", "py", "strong", F.coalesce("component", "id").alias("g"))
    on = group.groupBy("g").agg(F.max("strong").alias("hit")).where("hit").select("g")
    edges = group.join(on, "g", "left_semi").select("px", "py", F.lit(1).alias("edge"))
    return pixels.select(F.col("px").cast("long"), F.col("py").cast("long")).join(edges, ["px", "py"], "left").na.fill(0, ["edge"])


_RING = ((1, 0), (1, 1), (0, 1), (-1, 1), (-1, 0), (-1, -1), (0, -1), (1, -1))  # x, y; clockwise on a downward y axis


def outlines(mask: np.ndarray) -> list[np.ndarray]:
    """Outer borders of the 8-connected foreground parts, as pixel centres (x, y) in order."""
    m = np.pad(mask != 0, 1)
    done, out = np.zeros(m.shape, bool), []
    for y, x in np.argwhere(m & ~np.pad(m, 1)[1:-1, :-2]):  # pixels with background to the left
        if done[y, x]:
            continue
        stack, seen = [(y, x)], set()  # the part that this pixel belongs to
        while stack:
            p = stack.pop()
            if p in seen or not m[p]:
                continue
            seen.add(p)
            stack += [(p[0] + dy, p[1] + dx) for dx, dy in _RING]
        for p in seen:
            done[p] = True
        y, x = min(seen)
        path, at, back = [(x, y)], (x, y), 4  # came from the left
        first = None
        while True:
            for i in range(1, 9):
                k = (back + i) % 8
                nxt = (at[0] + _RING[k][0], at[1] + _RING[k][1])
                if (nxt[1], nxt[0]) in seen:
                    break
            else:
                break
            if first is None:
                first = (at, nxt)
            elif (at, nxt) == first:
                path.pop()
                break
            path.append(nxt)
            at, back = nxt, (k + 4) % 8
        out.append(np.array(path) - 1)
    return out


def shoelace(p: np.ndarray) -> float:
    return abs(float(np.sum(p[:, 0] * np.roll(p[:, 1], -1) - np.roll(p[:, 0], -1) * p[:, 1]))) / 2


def simplified(p: np.ndarray, epsilon: float) -> np.ndarray:
    """Douglas-Peucker on a closed line: split at the point farthest from the first, then each half."""
    if len(p) < 4:
        return p
    far = int(np.linalg.norm(p - p[0], axis=1).argmax())
    ring = np.vstack([p, p[:1]])
    keep = np.zeros(len(ring), bool)
    keep[[0, far, len(p)]] = True
    todo = [(0, far), (far, len(p))]
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        d, q = ring[b] - ring[a], ring[a + 1 : b] - ring[a]
        size = np.linalg.norm(d)
        dist = np.abs(d[0] * q[:, 1] - d[1] * q[:, 0]) / size if size else np.linalg.norm(q, axis=1)
        i = int(dist.argmax())
        if dist[i] > epsilon:
            keep[a + 1 + i] = True
            todo += [(a, a + 1 + i), (a + 1 + i, b)]
    return ring[:-1][keep[:-1]]


def polygon_of(mask: np.ndarray) -> np.ndarray | None:
    """The largest outline, simplified by a hundredth of its length (one pixel at least); None below three vertices."""
    found = [o for o in outlines(mask) if len(o) >= 3]
    if not found:
        return None
    best = max(found, key=shoelace).astype(float)
    length = float(np.linalg.norm(best - np.roll(best, -1, axis=0), axis=1).sum())
    p = simplified(best, max(1.0, 0.01 * length))
    return p if len(p) >= 3 else None


def mask_polygons(masks: DataFrame, gt, offset: tuple[float, float] = (0.0, 0.0)) -> DataFrame:
    """Adds ``polygon`` (array of x, y as floats in the cloud's coordinates; null if there is none) to rows with rle_mask and
    pixel_origin."""

    src = masks.drop("polygon")
    at = {c: i for i, c in enumerate(src.columns)}
    kind = pa.list_(pa.struct([("x", pa.float32()), ("y", pa.float32())]))

    def traced(mask: dict | None, origin: list | None) -> list[dict] | None:
        if not mask or not origin or not mask["size"] or mask["counts"] is None:
            return None
        (h, w), counts = mask["size"], np.asarray(mask["counts"], int)
        if not h * w or counts.sum() != h * w:
            return None
        p = polygon_of(np.repeat(np.arange(len(counts)) % 2, counts).reshape(h, w))
        if p is None:
            return None
        px, py = p[:, 0] + origin[0], p[:, 1] + origin[1]
        x = gt.origin_x + px * gt.pixel_w + py * gt.rot_x - offset[0]
        y = gt.origin_y + px * gt.rot_y + py * gt.pixel_h - offset[1]
        return [{"x": a, "y": b} for a, b in zip(x.tolist(), y.tolist())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [traced(m, o) for m, o in zip(b.column(at["rle_mask"]).to_pylist(), b.column(at["pixel_origin"]).to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, kind)], [*b.schema.names, "polygon"])

    schema = StructType([*src.schema.fields, StructField("polygon", ArrayType(StructType([StructField("x", FloatType()), StructField("y", FloatType())])))])
    return src.mapInArrow(run, schema)
