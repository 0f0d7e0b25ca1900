"""Detections from tiles: a pluggable segmentation model in ``mapInPandas``, then features as column functions."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geomosaic.functions import geo, rle

#: predict(crop) -> [(mask as a 2-d array, score)], for a crop of shape (height, width[, bands]).
Predict = Callable[[np.ndarray], list[tuple[np.ndarray, float]]]


@dataclass(frozen=True)
class DetectionConfig:
    confidence: float = 0.35
    max_per_tile: int = 1000
    min_diameter: float = 1.5


_MASK = "tile_ord long, source_patch_id string, x0 long, y0 long, mask_idx int, score double, height int, width int, pixels array<int>, error string"


def infer(crops: DataFrame, make_model: Callable[[], Predict]) -> DataFrame:
    """One row for each predicted mask of each crop (tile_ord, source_patch_id, x0, y0, height, width, data: bytes, row-major).

    ``make_model`` runs once in each task. Empty crops give nothing. A crop on which the model fails gives one row with the
    error and no mask, so failures can be counted.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        predict = make_model()
        for b in batches:
            rows = []
            for t in b.itertuples():
                if t.height <= 0 or t.width <= 0:
                    continue
                head = (t.tile_ord, t.source_patch_id, t.x0, t.y0)
                try:
                    found = predict(np.frombuffer(t.data, np.uint8).reshape(t.height, t.width, -1))
                except RuntimeError as e:
                    rows.append((*head, None, None, t.height, t.width, None, str(e)))
                    continue
                for i, (mask, score) in enumerate(found):
                    rows.append((*head, i, float(score), *mask.shape[:2], (np.asarray(mask) != 0).astype(int).ravel().tolist(), None))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in _MASK.split(", ")])

    return crops.mapInPandas(run, _MASK)


def detections(masks: DataFrame, gt: geo.Geotransform, cfg: DetectionConfig = DetectionConfig()) -> DataFrame:
    """Masks as detections: confident enough, at most so many a tile by score, not empty, large enough; then numbered by tile
    and mask (det_idx) by ``numbered``."""
    best = Window.partitionBy("tile_ord").orderBy(F.desc("score"), "mask_idx")
    m = masks.where(F.col("error").isNull() & (F.coalesce("score", F.lit(0.0)) >= cfg.confidence)).withColumn("_k", F.row_number().over(best)).where(F.col("_k") <= cfg.max_per_tile).drop("_k")
    m = m.withColumn("rle_mask", rle.encode(F.col("pixels"), F.col("height"), F.col("width"))).drop("pixels")
    return measured(m, gt, cfg.min_diameter)


def measured(masks: DataFrame, gt: geo.Geotransform, min_diameter: float = 0.0) -> DataFrame:
    """Adds area, diameter, centroid and box in world units to rows with rle_mask, x0 and y0."""
    m = masks.withColumn("f", rle.features(F.col("rle_mask"))).where(F.col("f").isNotNull())
    area = F.col("f.area") * F.lit(gt.resolution * gt.resolution)
    m = m.withColumn("area_m2", area).withColumn("equivalent_diameter_m", geo.equivalent_diameter(F.col("area_m2"))).where(F.col("equivalent_diameter_m") >= min_diameter)
    cx, cy = geo.pixel_to_world(gt, F.col("f.cx") + F.col("x0"), F.col("f.cy") + F.col("y0"))
    ax, ay = geo.pixel_to_world(gt, F.col("f.xmin") + F.col("x0"), F.col("f.ymin") + F.col("y0"))
    bx, by = geo.pixel_to_world(gt, F.col("f.xmax") + F.col("x0"), F.col("f.ymax") + F.col("y0"))
    m = m.withColumns({"cx": cx, "cy": cy, "xmin": F.least(ax, bx), "ymin": F.least(ay, by), "xmax": F.greatest(ax, bx), "ymax": F.greatest(ay, by)})
    return m.drop("f")


def numbered(found: DataFrame) -> DataFrame:
    """det_idx: the place of each detection in order of tile and mask."""
    from geomosaic.operators.fuse import with_ids

    keyed = found.withColumn("label", F.col("tile_ord") * F.lit(1 << 20) + F.col("mask_idx"))
    return keyed.join(with_ids(keyed.select("label")).select("label", F.col("si").alias("det_idx")), "label").drop("label")


def summary(found: DataFrame) -> DataFrame:
    """One row: how many, and least, greatest and mean area and diameter (null without detections)."""
    out = [F.count("*").alias("detection_count")]
    for c, n in (("area_m2", "area"), ("equivalent_diameter_m", "diameter")):
        out += [F.min(c).alias(f"{n}_min"), F.max(c).alias(f"{n}_max"), F.avg(c).alias(f"{n}_mean")]
    return found.agg(*out)
