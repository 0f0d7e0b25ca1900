"""Spatial joins as equi-joins on grid cells.

A distance condition alone would plan a nested loop over all pairs. Here one side is dealt to its own cell of the radius's
size and the other to that cell and its eight neighbours, so each pair in reach meets in exactly one cell; the exact
condition follows as a residual. Cells join by hash or sort-merge, with skew left to adaptive execution.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geomosaic.functions.geo import Box, affinity, affinity_radius, boxes_touch, distance, iou

DETECTION = ("det_idx", "source_patch_id", "cx", "cy", "xmin", "ymin", "xmax", "ymax")


def _cell(c: str, r: float) -> Column:
    return F.floor(F.col(c) / F.lit(float(r)))


def _around(c: str) -> Column:
    return F.sequence(F.col(c) - 1, F.col(c) + 1)


def pairs_within(points: DataFrame, radius: float, id_col: str = "det_idx") -> DataFrame:
    """Self-join: a_* and b_* columns and ``dist`` for each pair with a's id below b's and a distance up to ``radius``."""
    r = max(float(radius), 1e-9)
    cells = points.withColumn("gx", _cell("cx", r)).withColumn("gy", _cell("cy", r))
    a = cells.select(*[F.col(c).alias(f"a_{c}") for c in points.columns], "gx", "gy")
    b = cells.withColumn("gx", F.explode(_around("gx"))).withColumn("gy", F.explode(_around("gy"))).select(*[F.col(c).alias(f"b_{c}") for c in points.columns], "gx", "gy")
    d = distance(F.col("a_cx"), F.col("a_cy"), F.col("b_cx"), F.col("b_cy"))
    near = a.join(b, ["gx", "gy"]).where(F.col(f"a_{id_col}") < F.col(f"b_{id_col}")).withColumn("dist", d).where(F.col("dist") <= F.lit(float(radius)))
    return near.drop("gx", "gy")


@dataclass(frozen=True)
class HeuristicConfig:
    max_distance: float = 0.8
    min_iou: float = 0.3


@dataclass(frozen=True)
class CorrelationConfig:
    max_distance: float = 3.5
    sigma: float = 0.70
    threshold: float = 0.45
    iou_weight: float = 0.3
    same_tile_boost: float = 1.2
    need_overlap: bool = True


def _found(det: DataFrame) -> DataFrame:
    return det.select(*DETECTION)


def heuristic_edges(det: DataFrame, cfg: HeuristicConfig = HeuristicConfig()) -> DataFrame:
    """src, dst, iou: detections of different tiles that are close, touch and overlap enough. A missing tile counts as ''."""
    p = pairs_within(_found(det), cfg.max_distance)
    a, b = Box.of("a_"), Box.of("b_")
    tile = lambda s: F.coalesce(F.col(f"{s}_source_patch_id"), F.lit(""))
    p = p.where((tile("a") != tile("b")) & boxes_touch(a, b)).withColumn("iou", iou(a, b))
    if cfg.min_iou > 0:
        p = p.where(F.col("iou") >= cfg.min_iou)
    return p.select(F.col("a_det_idx").alias("src"), F.col("b_det_idx").alias("dst"), "iou")


def affinity_edges(det: DataFrame, cfg: CorrelationConfig = CorrelationConfig(), positive_only: bool = True) -> DataFrame:
    """src, dst, weight. With ``positive_only`` the search radius shrinks to what the threshold implies, which changes nothing
    but the work."""
    radius = affinity_radius(cfg.max_distance, cfg.sigma, cfg.iou_weight, cfg.same_tile_boost, cfg.threshold) if positive_only else cfg.max_distance
    p = pairs_within(_found(det), radius).where(F.col("dist") <= cfg.max_distance)
    a, b = Box.of("a_"), Box.of("b_")
    if cfg.need_overlap:
        p = p.where(boxes_touch(a, b))
    same = F.coalesce(F.col("a_source_patch_id"), F.lit("")) == F.coalesce(F.col("b_source_patch_id"), F.lit(""))
    p = p.withColumn("weight", affinity(F.col("dist"), iou(a, b), same, cfg.sigma, cfg.iou_weight, cfg.same_tile_boost))
    if positive_only:
        p = p.where(F.col("weight") >= cfg.threshold)
    return p.select(F.col("a_det_idx").alias("src"), F.col("b_det_idx").alias("dst"), "weight")


def in_polygon(polygon: Column, x: Column, y: Column) -> Column:
    """Whether a point is inside or on the boundary. polygon: array<struct<x, y>>, at least three vertices, not closed.

    Crossing number over the edges; a point on an edge counts as inside. An expression of built-in functions.
    """
    n = F.size(polygon)
    start = F.struct(F.lit(False).alias("odd"), F.lit(False).alias("on"))

    def edge(acc: Column, i: Column) -> Column:
        p, q = F.get(polygon, i), F.get(polygon, (i + 1) % n)
        px, py, qx, qy = (c.cast("double") for c in (p["x"], p["y"], q["x"], q["y"]))
        cross = (qx - px) * (y - py) - (qy - py) * (x - px)
        on = (cross == 0) & (x >= F.least(px, qx)) & (x <= F.greatest(px, qx)) & (y >= F.least(py, qy)) & (y <= F.greatest(py, qy))
        straddles = (py > y) != (qy > y)
        left = F.when(qy > py, cross > 0).otherwise(cross < 0)
        return F.struct((acc["odd"] != (straddles & left)).alias("odd"), (acc["on"] | on).alias("on"))

    walked = F.aggregate(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), start, edge)
    return (n >= 3) & (walked["odd"] | walked["on"])


#: Estimated bytes of the objects' side up to which it is broadcast.
BROADCAST_BYTES = 64 << 20


def located(points: DataFrame, polygons: DataFrame, pad: float = 0.5, cell: float = 2.0, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``points`` (ord, x, y and more) with si: the smallest among the objects that hold the point, null if none does.

    polygons: si, polygon, one or more rows for each object. An object's boxes are united, padded and dealt to the cells they
    touch. If those cells' estimated bytes are few, each is one row with all its objects, and points meet it by a broadcast
    join: they are not shuffled. Else both sides are shuffled by cell, one row an object and cell, and the hits by ``ord``.
    """
    xs = lambda f: f(F.transform("polygon", lambda p: p["x"].cast("float")))
    ys = lambda f: f(F.transform("polygon", lambda p: p["y"].cast("float")))
    boxed = polygons.groupBy("si").agg(F.collect_list("polygon").alias("polygons"), F.min(xs(F.array_min)).alias("x0"), F.min(ys(F.array_min)).alias("y0"), F.max(xs(F.array_max)).alias("x1"), F.max(ys(F.array_max)).alias("y1"))
    p = F.lit(float(pad))
    boxed = boxed.select("si", "polygons", (F.col("x0") - p).cast("float").alias("x0"), (F.col("y0") - p).cast("float").alias("y0"), (F.col("x1") + p).cast("float").alias("x1"), (F.col("y1") + p).cast("float").alias("y1"))
    at = lambda c: F.floor(F.col(c).cast("double") / F.lit(float(cell)))
    dealt = boxed.withColumn("gx", F.explode(F.sequence(at("x0"), at("x1")))).withColumn("gy", F.explode(F.sequence(at("y0"), at("y1"))))
    from geomosaic import session

    dealt = session.written(points.sparkSession, dealt, "cells")
    vertices = F.aggregate("polygons", F.lit(0), lambda n, q: n + F.size(q))
    size = dealt.agg(F.sum(F.lit(64) + 16 * vertices)).head()[0] or 0
    placed = points.withColumn("gx", at("x")).withColumn("gy", at("y"))
    x, y = F.col("x").cast("float"), F.col("y").cast("float")
    holds = lambda o: (x >= o["x0"]) & (x <= o["x1"]) & (y >= o["y0"]) & (y <= o["y1"]) & F.exists(o["polygons"], lambda poly: in_polygon(poly, x.cast("double"), y.cast("double")))
    held = F.struct("si", "polygons", "x0", "y0", "x1", "y1")
    if size <= broadcast_bytes:
        cells = dealt.groupBy("gx", "gy").agg(F.collect_list(held).alias("objects"))
        found = F.array_min(F.transform(F.filter(F.coalesce("objects", F.array()), holds), lambda o: o["si"]))
        return placed.join(F.broadcast(cells), ["gx", "gy"], "left").withColumn("si", found).drop("gx", "gy", "objects")
    hit = placed.select("ord", "x", "y", "gx", "gy").join(dealt.select("gx", "gy", held.alias("o")), ["gx", "gy"]).where(holds(F.col("o")))
    return points.join(hit.groupBy("ord").agg(F.min("o.si").alias("si")), "ord", "left")


def points_in_objects(points: DataFrame, polygons: DataFrame, pad: float = 0.5, cell: float = 2.0, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """ord, si: the points inside an object, with the smallest si among those that hold it (see ``located``)."""
    return located(points.select("ord", "x", "y"), polygons, pad, cell, broadcast_bytes).where("si IS NOT NULL").select("ord", "si")
