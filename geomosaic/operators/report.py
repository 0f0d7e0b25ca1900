"""Report rows: overlay geometry, comparison of methods, and the files that a stage leaves behind.

Charts and overlays are rows, not pictures: whoever draws them needs no more than these. Documents of a stage (a summary with
its rows) are written as one JSON text each by Spark's writers, rows beside them as Parquet.
"""

from __future__ import annotations

import html
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geomosaic.functions import geo

STATUS_COLORS = {"kept": "#2ecc71", "skipped": "#e74c3c"}


def _boxed(rows: DataFrame, gt: geo.Geotransform, scale: float, *extra: Column) -> DataFrame:
    box = geo.scaled_pixel_box(gt, scale, geo.Box.of())
    return rows.select(box.xmin.alias("x0"), box.ymin.alias("y0"), box.xmax.alias("x1"), box.ymax.alias("y1"), *extra)


def window_overlay(tiles: DataFrame, gt: geo.Geotransform, scale: float) -> DataFrame:
    """Pixel boxes of the windows with the last four characters of their ids and a colour by status."""
    kept = F.col("status") == "kept"
    return _boxed(tiles, gt, scale, F.col("patch_id").alias("id"), geo.short_label(F.col("patch_id")).alias("label"), F.when(kept, STATUS_COLORS["kept"]).otherwise(STATUS_COLORS["skipped"]).alias("color"))


def level_overlay(tiles: DataFrame, gt: geo.Geotransform, scale: float) -> DataFrame:
    """Pixel boxes of the kept adaptive tiles with their level, held to four colours."""
    level = geo.quadtree_level(F.col("tile_id"))
    return _boxed(tiles.where("NOT skipped"), gt, scale, F.col("tile_id").alias("id"), F.format_string("L%d", level).alias("label"), F.greatest(F.lit(0), F.least(level, F.lit(3))).alias("color"))


def density_overlay(tiles: DataFrame, gt: geo.Geotransform, scale: float) -> DataFrame:
    """Pixel boxes of the kept adaptive tiles with an intensity of 0..255 by their share of the largest edge density."""
    top = tiles.where("NOT skipped").agg(F.coalesce(F.max("edge_density"), F.lit(1.0)).alias("top"))
    return _boxed(tiles.where("NOT skipped").crossJoin(F.broadcast(top)), gt, scale, F.col("tile_id").alias("id"), F.format_string("%.2f", "edge_density").alias("label"), geo.intensity(F.col("edge_density"), F.col("top")).alias("color"))


def fusion_overlay(found: DataFrame, gt: geo.Geotransform, scale: float, method: str) -> DataFrame:
    """Pixel boxes of fused objects that are large enough to draw, with colour and class by the number of members."""
    n = F.col("source_detection_count")
    rows = _boxed(found, gt, scale, F.lit(method).alias("method"), F.col("label").alias("id"), n.alias("members"), geo.cluster_class(n).alias("class"), geo.cluster_color(n).alias("color"))
    return rows.where(geo.drawable(geo.Box(*(F.col(c) for c in ("x0", "y0", "x1", "y1")))))


def compared(summaries: dict[str, DataFrame]) -> DataFrame:
    """One row a method from tiling summaries of either kind: total, kept, skipped, coverage and skipped share as text."""
    out = None
    for method, s in summaries.items():
        has = set(s.columns)
        pick = lambda *names: F.coalesce(*[F.col(c).cast("string") for c in names if c in has], F.lit("?"))
        row = s.select(F.lit(method).alias("method"), pick("total_patches", "total_tiles").alias("total"), pick("kept_patches", "kept_tiles").alias("kept"), pick("skipped_patches", "skipped_tiles").alias("skipped"), geo.percent(F.coalesce("coverage_ratio", F.lit(0.0))).alias("coverage"))
        out = row if out is None else out.unionByName(row)
    return out


def as_html(rows: DataFrame, title: str) -> str:
    """A page with one table of a small summary (a row a method)."""
    cell = lambda tag, v: f"<{tag}>{html.escape('' if v is None else str(v))}</{tag}>"
    head = "".join(cell("th", c) for c in rows.columns)
    body = "".join("<tr>" + "".join(cell("td", v) for v in r) + "</tr>" for r in rows.collect())
    return f"<!doctype html><meta charset=utf-8><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1><table><tr>{head}</tr>{body}</table>"


def document(summary: DataFrame, **rows: DataFrame) -> DataFrame:
    """One row ``value``: the summary's columns as JSON. Row tables are written beside it, not nested into it."""
    return summary.select(F.to_json(F.struct(*summary.columns)).alias("value"))


def write_stage(folder: str, summary: DataFrame, **rows: DataFrame) -> None:
    """``folder``/summary as JSON text, and each named table as Parquet beside it."""
    document(summary).coalesce(1).write.mode("overwrite").text(f"{folder}/summary")
    for name, table in rows.items():
        table.write.mode("overwrite").parquet(f"{folder}/{name}")


def write_manifest(spark: SparkSession, folder: str, runs: dict[str, dict]) -> None:
    """method, stats of a run, written anew each time."""
    rows = [(m, json.dumps(s, sort_keys=True)) for m, s in sorted(runs.items())]
    spark.createDataFrame(rows, "method string, stats string").coalesce(1).write.mode("overwrite").json(f"{folder}/manifest")


def read_summary(spark: SparkSession, folder: str, schema) -> DataFrame:
    return spark.read.text(f"{folder}/summary").select(F.from_json("value", schema).alias("s")).select("s.*")
