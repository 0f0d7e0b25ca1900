"""Cutting a raster into windows or an adaptive quadtree, and zonal aggregates over its pixels.

Pixels come as rows (px, py, ...). A pixel finds its windows by arithmetic, not by a join, and every aggregate has a partial
step before its shuffle; what is shuffled is one row for each tile and task.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geomosaic import session
from geomosaic.functions.geo import Box, Geotransform, expand_bounds, numbered, pixel_to_world


@dataclass(frozen=True)
class WindowConfig:
    size: int = 1024
    overlap: float = 0.3
    black: float = 5
    min_content: float = 0.1
    include_edge: bool = True

    @property
    def stride(self) -> int:
        return max(1, round(self.size * (1 - self.overlap)))


def window_positions(limit: int, cfg: WindowConfig) -> Column:
    """array<bigint>: 0 alone if one window covers the side; else every stride, and a last window flush with the far edge."""
    if limit <= cfg.size:
        return F.array(F.lit(0).cast("long"))
    last = F.lit(limit - cfg.size).cast("long")
    regular = F.sequence(F.lit(0).cast("long"), last, F.lit(cfg.stride).cast("long"))
    return F.array_sort(F.array_distinct(F.concat(regular, F.array(last)))) if cfg.include_edge else regular


def tile_grid(spark: SparkSession, width: int, height: int, gt: Geotransform, cfg: WindowConfig) -> DataFrame:
    """One row for each window: patch_id, row, col, x, y, size and world bounds. Ids run along rows."""
    one = spark.range(1)
    ys = one.select(F.posexplode(window_positions(height, cfg)).alias("row", "y"))
    xs = one.select(F.posexplode(window_positions(width, cfg)).alias("col", "x"), F.size(window_positions(width, cfg)).alias("ncols"))
    t = ys.crossJoin(xs)  # two generated lists of window positions
    ax, ay = pixel_to_world(gt, F.col("x"), F.col("y"))
    bx, by = pixel_to_world(gt, F.least(F.col("x") + cfg.size, F.lit(width)), F.least(F.col("y") + cfg.size, F.lit(height)))
    return t.select(
        numbered("patch", F.col("row") * F.col("ncols") + F.col("col")).alias("patch_id"), "row", "col", "x", "y", F.lit(cfg.size).alias("pixel_size"),
        F.least(ax, bx).alias("xmin"), F.least(ay, by).alias("ymin"), F.greatest(ax, bx).alias("xmax"), F.greatest(ay, by).alias("ymax"),
    )


def _covering(p: Column, limit: int, cfg: WindowConfig) -> Column:
    """The positions of the windows that cover pixel p along one side: at most ceil(size / stride) + 1."""
    if limit <= cfg.size:
        return F.array(F.lit(0).cast("long"))
    top, st = (limit - cfg.size) // cfg.stride, cfg.stride
    lo = F.greatest(F.lit(0).cast("long"), F.ceil((p - (cfg.size - 1)) / F.lit(st)))
    hi = F.least(F.lit(top).cast("long"), F.floor(p / F.lit(st)))
    regular = F.when(lo <= hi, F.transform(F.sequence(lo, hi), lambda k: k * st)).otherwise(F.array().cast("array<bigint>"))
    last = limit - cfg.size
    if not cfg.include_edge or last % st == 0:
        return regular
    return F.when(p >= last, F.concat(regular, F.array(F.lit(last).cast("long")))).otherwise(regular)


def zonal(pixels: DataFrame, width: int, height: int, cfg: WindowConfig, **aggregates: Column) -> DataFrame:
    """x, y and the aggregates of each window over its pixels."""
    px, py = F.col("px").cast("long"), F.col("py").cast("long")
    spread = pixels.withColumn("x", F.explode(_covering(px, width, cfg))).withColumn("y", F.explode(_covering(py, height, cfg)))
    return spread.groupBy("x", "y").agg(*[a.alias(n) for n, a in aggregates.items()])


def tile_status(grid: DataFrame, pixels: DataFrame, width: int, height: int, cfg: WindowConfig) -> DataFrame:
    """The grid with content_ratio (share of pixels brighter than black), black_ratio and status."""
    content = zonal(pixels, width, height, cfg, content_ratio=F.avg((F.col("v") > cfg.black).cast("double")))
    out = grid.join(content, ["x", "y"], "left").withColumn("content_ratio", F.coalesce("content_ratio", F.lit(0.0)))
    return out.withColumn("black_ratio", 1 - F.col("content_ratio")).withColumn("status", F.when(F.col("content_ratio") >= cfg.min_content, "kept").otherwise("skipped_black"))


def tiling_summary(tiles: DataFrame, width: int, height: int) -> DataFrame:
    """One row: counts, share of the raster inside the kept tiles' common box, sizes, mean content of what was skipped."""
    kept = F.col("status") == "kept"
    span = lambda lo, hi: F.max(F.when(kept, hi)) - F.min(F.when(kept, lo))
    box = span(F.col("x"), F.least(F.col("x") + F.col("pixel_size"), F.lit(width))) * span(F.col("y"), F.least(F.col("y") + F.col("pixel_size"), F.lit(height)))
    return tiles.agg(
        F.count("*").alias("total_patches"), F.count_if(kept).alias("kept_patches"), F.count_if(~kept).alias("skipped_patches"),
        F.least(F.lit(1.0), F.coalesce(box / F.lit(float(width * height)), F.lit(0.0))).alias("coverage_ratio"),
        F.coalesce(F.avg(F.when(~kept, F.col("content_ratio"))), F.lit(0.0)).alias("skipped_ratio"),
        F.coalesce(F.min("pixel_size"), F.lit(0)).alias("min_px"), F.coalesce(F.max("pixel_size"), F.lit(0)).alias("max_px"),
        F.coalesce(F.avg("pixel_size"), F.lit(0.0)).alias("mean_px"), (F.count_distinct("pixel_size") <= 1).alias("all_same_size"),
    )


@dataclass(frozen=True)
class QuadtreeConfig:
    base: float = 20.0
    min_size: float = 10.0
    density: float = 0.15
    overlap: float = 3.0
    min_content: float = 0.15
    black: float = 5


def quadtree_grid(spark: SparkSession, bounds: tuple[float, float, float, float], base: float) -> DataFrame:
    """Base tiles: tile_id (``tile_ix_iy``), ix, iy, path (empty) and bounds clipped to the raster. At least one per axis."""
    x0, y0, x1, y1 = bounds
    nx, ny = max(1, math.ceil((x1 - x0) / base)), max(1, math.ceil((y1 - y0) / base))
    one = spark.range(1)
    t = one.select(F.explode(F.sequence(F.lit(0), F.lit(nx - 1))).alias("ix")).crossJoin(one.select(F.explode(F.sequence(F.lit(0), F.lit(ny - 1))).alias("iy")))
    bx, by = F.lit(x0) + F.col("ix") * F.lit(base), F.lit(y0) + F.col("iy") * F.lit(base)
    return t.select(
        F.concat_ws("_", F.lit("tile"), "ix", "iy").alias("tile_id"), "ix", "iy", F.lit("").alias("path"),
        bx.alias("xmin"), by.alias("ymin"), F.least(bx + F.lit(base), F.lit(x1)).alias("xmax"), F.least(by + F.lit(base), F.lit(y1)).alias("ymax"),
    )


def _pixel_window(box: Box, bounds, width: int, height: int) -> tuple[Column, Column, Column, Column]:
    """Half-open pixel ranges of a tile: both corners as valid indices, in order."""
    from geomosaic.functions.geo import world_to_pixel

    ax, ay = world_to_pixel(bounds, width, height, box.xmin, box.ymax)
    bx, by = world_to_pixel(bounds, width, height, box.xmax, box.ymin)
    return F.least(ax, bx), F.least(ay, by), F.greatest(ax, bx), F.greatest(ay, by)


def quadtree(spark: SparkSession, pixels: DataFrame, bounds, width: int, height: int, cfg: QuadtreeConfig, block: int = 64) -> DataFrame:
    """Leaf tiles of the adaptive split: tile_id, expanded bounds, edge_density, content_ratio, pixel window, skipped and why.

    Level by level: all tiles of a level are measured by one join of pixels and tiles on block cells, then judged in this
    order: too dark, no edges, dense and large (four children), kept. Decisions use the tiles' own bounds; the overlap is added
    on output. The rounds are the depth of the tree, log2(base / min_size) + 1 or one more by rounding.
    """
    tiles, done = quadtree_grid(spark, bounds, cfg.base), None
    rounds = max(1, math.ceil(math.log2(max(cfg.base / cfg.min_size, 1.0))) + 2)
    cells = pixels.select("px", "py", "v", "edge", F.floor(F.col("px") / block).alias("bx"), F.floor(F.col("py") / block).alias("by"))
    for level in range(rounds):
        w = _pixel_window(Box.of(), bounds, width, height)
        tiles = tiles.select("tile_id", "ix", "iy", "path", "xmin", "ymin", "xmax", "ymax", *(c.alias(n) for c, n in zip(w, ("px0", "py0", "px1", "py1"))))
        spread = tiles.where("px1 > px0 AND py1 > py0").select("tile_id", "px0", "py0", "px1", "py1", F.explode(F.sequence(F.floor(F.col("px0") / block), F.floor((F.col("px1") - 1) / block))).alias("bx")).withColumn("by", F.explode(F.sequence(F.floor(F.col("py0") / block), F.floor((F.col("py1") - 1) / block))))
        inside = (F.col("px") >= F.col("px0")) & (F.col("px") < F.col("px1")) & (F.col("py") >= F.col("py0")) & (F.col("py") < F.col("py1"))
        sums = cells.join(spread, ["bx", "by"]).where(inside).groupBy("tile_id").agg(F.count("*").alias("n"), F.count_if(F.col("edge") != 0).alias("edges"), F.count_if(F.col("v") > cfg.black).alias("bright"))
        seen = tiles.join(sums, "tile_id", "left").na.fill(0, ["n", "edges", "bright"])
        n = F.greatest(F.col("n"), F.lit(1)).cast("double")
        seen = seen.withColumn("edge_density", F.col("edges") / n).withColumn("content_ratio", F.col("bright") / n)
        large = F.greatest(F.col("xmax") - F.col("xmin"), F.col("ymax") - F.col("ymin")) > cfg.min_size
        fate = F.when(F.col("content_ratio") < cfg.min_content, "black").when(F.col("edges") == 0, "no_edges").when((F.col("edge_density") >= cfg.density) & large, "split").otherwise("")
        seen = session.written(spark, seen.withColumn("fate", fate), "level")  # the next level doesn't measure this one again
        leaves = seen.where("fate <> 'split'")
        done = leaves if done is None else done.unionByName(leaves)
        if level == rounds - 1:
            break
        mx, my = (F.col("xmin") + F.col("xmax")) / 2, (F.col("ymin") + F.col("ymax")) / 2
        quarter = lambda i, a, b, c, d: F.struct(F.lit(i).alias("i"), a.alias("xmin"), b.alias("ymin"), c.alias("xmax"), d.alias("ymax"))
        x0, y0, x1, y1 = (F.col(c) for c in ("xmin", "ymin", "xmax", "ymax"))
        kids = F.array(quarter("0", x0, y0, mx, my), quarter("1", mx, y0, x1, my), quarter("2", x0, my, mx, y1), quarter("3", mx, my, x1, y1))
        tiles = seen.where("fate = 'split'").select("tile_id", "ix", "iy", "path", F.explode(kids).alias("q")).select(F.concat_ws("_", "tile_id", "q.i").alias("tile_id"), "ix", "iy", F.concat("path", "q.i").alias("path"), "q.xmin", "q.ymin", "q.xmax", "q.ymax")
    out = expand_bounds(Box.of(), cfg.overlap, bounds)
    return done.select(
        "tile_id", "ix", "iy", "path", out.xmin.alias("xmin"), out.ymin.alias("ymin"), out.xmax.alias("xmax"), out.ymax.alias("ymax"),
        "edge_density", "content_ratio", "px0", "py0", "px1", "py1", (F.col("fate") != "").alias("skipped"), F.col("fate").alias("skip_reason"),
    )


def quadtree_summary(tiles: DataFrame, bounds) -> DataFrame:
    """One row: counts, the kept tiles' common box against the raster, and tile areas over all tiles."""
    x0, y0, x1, y1 = bounds
    area, kept = (F.col("xmax") - F.col("xmin")) * (F.col("ymax") - F.col("ymin")), ~F.col("skipped")
    box = (F.max(F.when(kept, F.col("xmax"))) - F.min(F.when(kept, F.col("xmin")))) * (F.max(F.when(kept, F.col("ymax"))) - F.min(F.when(kept, F.col("ymin"))))
    whole = (x1 - x0) * (y1 - y0)
    return tiles.agg(
        F.count("*").alias("total_tiles"), F.count_if(kept).alias("kept_tiles"), F.count_if(~kept).alias("skipped_tiles"), F.lit(whole).alias("dom_area_m2"),
        F.coalesce(box, F.lit(0.0)).alias("unique_coverage_m2"), F.least(F.lit(1.0), F.coalesce(box, F.lit(0.0)) / F.lit(whole)).alias("coverage_ratio"),
        F.coalesce(F.min(area), F.lit(0.0)).alias("min_m2"), F.coalesce(F.max(area), F.lit(0.0)).alias("max_m2"), F.coalesce(F.avg(area), F.lit(0.0)).alias("mean_m2"),
    )


def kept_tiles(tiles: DataFrame, limit: int = 0, order: str | None = None) -> DataFrame:
    """Tiles to work on, from either tiling (a missing status counts as kept, a missing skip as false); 0 is no limit."""
    has = set(tiles.columns)
    status = F.coalesce(F.col("status"), F.lit("kept")) if "status" in has else F.lit("kept")
    skipped = F.coalesce(F.col("skipped"), F.lit(False)) if "skipped" in has else F.lit(False)
    out = tiles.where((status == "kept") & ~skipped)
    return out.orderBy(order or ("patch_id" if "patch_id" in has else "tile_id")).limit(limit) if limit else out
