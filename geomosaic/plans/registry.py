"""All queries of the engine by name, and DuckDB SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geomosaic import session
from geomosaic.functions import geo, rle
from geomosaic.operators import detect, fuse, graph, points, report, spatial_join, stats, tiling, vision, volume
from geomosaic.plans import fixtures as fx
from geomosaic.sources import las, raster

GT = geo.Geotransform(623422.47, 0.01, 0.0, 4678756.5, 0.0, -0.01)
DOM_W, DOM_H = 7270, 22730
WIN = tiling.WindowConfig()
SMALL = tiling.WindowConfig(size=128)
PIX_GT = geo.Geotransform(0.0, 0.125, 0.0, 64.0, 0.0, -0.125)
PIX_BOUNDS = (0.0, 0.0, 80.0, 64.0)
QUAD = tiling.QuadtreeConfig(base=20.0, min_size=5.0)

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function of (spark, sf_dir) under its name, with SQL for the same rows where there is some."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            session.ship(spark)
            return f(spark, sf_dir)

        QUERIES[f.__name__] = run
        if sql:
            ORACLES[f.__name__] = fx.duck(sql)
        return run

    return add


def _detections(spark, d):
    return fx.frame(spark, d, fx.DETECTIONS)


_DET = f"det AS ({fx.DETECTIONS})"
_PIX = f"pix AS ({fx.PIXELS})"
_MSK = f"msk AS ({fx.MASKS_DUCK})"
_PTS = f"pts AS ({fx.POINTS})"
_CLD = f"cld AS ({fx.CLOUDS})"
_MEA = f"mea AS ({fx.MEASURES})"
_OBJ = f"obj AS ({fx.OBJECTS})"


# Tiling


def _positions_sql(limit: int, size: int, stride: int) -> str:
    return f"SELECT DISTINCT p FROM (SELECT unnest(range(0, {limit - size + 1}, {stride})) AS p UNION ALL SELECT CAST({limit - size} AS BIGINT)) a"


@query(f"SELECT 'x' AS axis, p AS position FROM ({_positions_sql(DOM_W, 1024, 717)}) x UNION ALL SELECT 'y', p FROM ({_positions_sql(DOM_H, 1024, 717)}) y")
def window_positions(spark, d):
    one = spark.range(1)
    side = lambda n, limit: one.select(F.lit(n).alias("axis"), F.explode(tiling.window_positions(limit, WIN)).alias("position"))
    return side("x", DOM_W).unionByName(side("y", DOM_H))


def _grid_sql(w, h, size, stride, ox, pw, oy, ph) -> str:
    return f"""gx AS (SELECT p AS x, row_number() OVER (ORDER BY p) - 1 AS col FROM ({_positions_sql(w, size, stride)}) q),
gy AS (SELECT p AS y, row_number() OVER (ORDER BY p) - 1 AS row FROM ({_positions_sql(h, size, stride)}) q),
grid AS (SELECT 'patch_' || lpad(CAST(row * (SELECT count(*) FROM gx) + col AS VARCHAR), 6, '0') AS patch_id, row, col, x, y,
  {ox}::DOUBLE + x * {pw}::DOUBLE AS xmin, {oy}::DOUBLE + least(y + {size}, {h}) * {ph}::DOUBLE AS ymin,
  {ox}::DOUBLE + least(x + {size}, {w}) * {pw}::DOUBLE AS xmax, {oy}::DOUBLE + y * {ph}::DOUBLE AS ymax FROM gx CROSS JOIN gy)"""


@query(f"WITH {_grid_sql(DOM_W, DOM_H, 1024, 717, 623422.47, 0.01, 4678756.5, -0.01)} SELECT patch_id, row, col, x, y, round(xmin, 6) AS xmin, round(ymin, 6) AS ymin, round(xmax, 6) AS xmax, round(ymax, 6) AS ymax FROM grid")
def tile_grid(spark, d):
    g = tiling.tile_grid(spark, DOM_W, DOM_H, GT, WIN)
    return g.select("patch_id", F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), "x", "y", *[F.round(c, 6).alias(c) for c in ("xmin", "ymin", "xmax", "ymax")])


_STATUS = f"""{_PIX}, {_grid_sql(fx.WIDTH, fx.HEIGHT, 128, 90, 0.0, 0.125, 64.0, -0.125)},
zone AS (SELECT g.x, g.y, avg(CASE WHEN v > 5 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS content_ratio FROM grid g JOIN pix ON px >= g.x AND px < g.x + 128 AND py >= g.y AND py < g.y + 128 GROUP BY g.x, g.y),
tiles AS (SELECT g.*, z.content_ratio, CASE WHEN z.content_ratio >= 0.1 THEN 'kept' ELSE 'skipped_black' END AS status FROM grid g JOIN zone z USING (x, y))"""


def _status(spark, d):
    pix = fx.frame(spark, d, fx.PIXELS)
    return tiling.tile_status(tiling.tile_grid(spark, fx.WIDTH, fx.HEIGHT, PIX_GT, SMALL), pix, fx.WIDTH, fx.HEIGHT, SMALL)


@query(f"WITH {_STATUS} SELECT patch_id, x, y, round(content_ratio, 6) AS content_ratio, status FROM tiles")
def tile_content_status(spark, d):
    return _status(spark, d).select("patch_id", "x", "y", F.round("content_ratio", 6).alias("content_ratio"), "status")


@query(f"""WITH {_STATUS} SELECT count(*) AS total_patches, count(*) FILTER (WHERE status = 'kept') AS kept_patches, count(*) FILTER (WHERE status <> 'kept') AS skipped_patches,
round(least(1.0, (max(x + 128) FILTER (WHERE status = 'kept') - min(x) FILTER (WHERE status = 'kept')) * (max(y + 128) FILTER (WHERE status = 'kept') - min(y) FILTER (WHERE status = 'kept')) / {fx.WIDTH * fx.HEIGHT}.0::DOUBLE), 6) AS coverage_ratio,
round(coalesce(avg(content_ratio) FILTER (WHERE status <> 'kept'), 0.0), 6) AS skipped_ratio, 128 AS min_px, 128 AS max_px, 128.0::DOUBLE AS mean_px, true AS all_same_size FROM tiles""")
def tiling_summary(spark, d):
    s = tiling.tiling_summary(_status(spark, d), fx.WIDTH, fx.HEIGHT)
    return s.withColumns({c: F.round(c, 6) for c in ("coverage_ratio", "skipped_ratio")})


_QGRID = """base AS (SELECT 'tile_' || ix || '_' || iy AS tile_id, CAST(ix AS INTEGER) AS ix, CAST(iy AS INTEGER) AS iy, '' AS path, 0.0::DOUBLE + ix * 20.0::DOUBLE AS xmin, 0.0::DOUBLE + iy * 20.0::DOUBLE AS ymin,
  least(0.0::DOUBLE + ix * 20.0::DOUBLE + 20.0::DOUBLE, 80.0::DOUBLE) AS xmax, least(0.0::DOUBLE + iy * 20.0::DOUBLE + 20.0::DOUBLE, 64.0::DOUBLE) AS ymax FROM (SELECT unnest(range(4)) AS ix) a CROSS JOIN (SELECT unnest(range(4)) AS iy) b)"""


@query(f"WITH {_QGRID} SELECT tile_id, xmin, ymin, xmax, ymax FROM base")
def quadtree_grid(spark, d):
    return tiling.quadtree_grid(spark, PIX_BOUNDS, 20.0).select("tile_id", "xmin", "ymin", "xmax", "ymax")


def _level(src: str) -> str:
    """Tiles measured and judged."""
    w, h = fx.WIDTH, fx.HEIGHT
    return f"""SELECT t.*, coalesce(n, 0) AS n, coalesce(edges, 0) / greatest(coalesce(n, 0), 1)::DOUBLE AS edge_density, coalesce(bright, 0) / greatest(coalesce(n, 0), 1)::DOUBLE AS content_ratio,
 CASE WHEN coalesce(bright, 0) / greatest(coalesce(n, 0), 1)::DOUBLE < 0.15 THEN 'black' WHEN coalesce(edges, 0) = 0 THEN 'no_edges'
  WHEN coalesce(edges, 0) / greatest(coalesce(n, 0), 1)::DOUBLE >= 0.15 AND greatest(xmax - xmin, ymax - ymin) > 5.0 THEN 'split' ELSE '' END AS fate
FROM (SELECT *, greatest(0, least(CAST(trunc(xmin / 80.0 * {w}.0) AS BIGINT), {w - 1})) AS px0, greatest(0, least(CAST(trunc((64.0 - ymax) / 64.0 * {h}.0) AS BIGINT), {h - 1})) AS py0,
  greatest(0, least(CAST(trunc(xmax / 80.0 * {w}.0) AS BIGINT), {w - 1})) AS px1, greatest(0, least(CAST(trunc((64.0 - ymin) / 64.0 * {h}.0) AS BIGINT), {h - 1})) AS py1 FROM {src}) t
LEFT JOIN (SELECT tile_id, count(*) AS n, sum(edge) AS edges, count(*) FILTER (WHERE v > 5) AS bright FROM (SELECT *, greatest(0, least(CAST(trunc(xmin / 80.0 * {w}.0) AS BIGINT), {w - 1})) AS px0, greatest(0, least(CAST(trunc((64.0 - ymax) / 64.0 * {h}.0) AS BIGINT), {h - 1})) AS py0,
  greatest(0, least(CAST(trunc(xmax / 80.0 * {w}.0) AS BIGINT), {w - 1})) AS px1, greatest(0, least(CAST(trunc((64.0 - ymin) / 64.0 * {h}.0) AS BIGINT), {h - 1})) AS py1 FROM {src}) s
  JOIN pix ON px >= px0 AND px < px1 AND py >= py0 AND py < py1 GROUP BY tile_id) z USING (tile_id)"""


def _children(src: str) -> str:
    parts = [("0", "xmin", "ymin", "(xmin + xmax) / 2", "(ymin + ymax) / 2"), ("1", "(xmin + xmax) / 2", "ymin", "xmax", "(ymin + ymax) / 2"), ("2", "xmin", "(ymin + ymax) / 2", "(xmin + xmax) / 2", "ymax"), ("3", "(xmin + xmax) / 2", "(ymin + ymax) / 2", "xmax", "ymax")]
    return " UNION ALL ".join(f"SELECT tile_id || '_{i}' AS tile_id, ix, iy, path || '{i}' AS path, {a} AS xmin, {b} AS ymin, {c} AS xmax, {e} AS ymax FROM {src} WHERE fate = 'split'" for i, a, b, c, e in parts)


_QUADTREE = f"""{_PIX}, {_QGRID}, l0 AS ({_level('base')}), c1 AS ({_children('l0')}), l1 AS ({_level('c1')}), c2 AS ({_children('l1')}), l2 AS ({_level('c2')}),
leaf AS (SELECT tile_id, greatest(0.0, xmin - 1.5) AS xmin, greatest(0.0, ymin - 1.5) AS ymin, least(80.0, xmax + 1.5) AS xmax, least(64.0, ymax + 1.5) AS ymax, edge_density, content_ratio, px0, py0, px1, py1, fate <> '' AS skipped, fate AS skip_reason
 FROM (SELECT * FROM l0 UNION ALL SELECT * FROM l1 UNION ALL SELECT * FROM l2) u WHERE fate <> 'split')"""


def _quadtree(spark, d):
    return tiling.quadtree(spark, fx.frame(spark, d, fx.PIXELS), PIX_BOUNDS, fx.WIDTH, fx.HEIGHT, QUAD)


@query(f"WITH {_QUADTREE} SELECT tile_id, xmin, ymin, xmax, ymax, round(edge_density, 6) AS edge_density, round(content_ratio, 6) AS content_ratio, px0, py0, px1, py1, skipped, skip_reason FROM leaf")
def quadtree_tiles(spark, d):
    return _quadtree(spark, d).drop("ix", "iy", "path").withColumns({c: F.round(c, 6) for c in ("edge_density", "content_ratio")})


@query(f"""WITH {_QUADTREE}, b AS (SELECT *, (xmax - xmin) * (ymax - ymin) AS a FROM leaf) SELECT count(*) AS total_tiles, count(*) FILTER (WHERE NOT skipped) AS kept_tiles, count(*) FILTER (WHERE skipped) AS skipped_tiles, 5120.0::DOUBLE AS dom_area_m2,
round((max(xmax) FILTER (WHERE NOT skipped) - min(xmin) FILTER (WHERE NOT skipped)) * (max(ymax) FILTER (WHERE NOT skipped) - min(ymin) FILTER (WHERE NOT skipped)), 6) AS unique_coverage_m2,
round(least(1.0, (max(xmax) FILTER (WHERE NOT skipped) - min(xmin) FILTER (WHERE NOT skipped)) * (max(ymax) FILTER (WHERE NOT skipped) - min(ymin) FILTER (WHERE NOT skipped)) / 5120.0), 6) AS coverage_ratio,
round(min(a), 6) AS min_m2, round(max(a), 6) AS max_m2, round(avg(a), 6) AS mean_m2 FROM b""")
def quadtree_summary(spark, d):
    s = tiling.quadtree_summary(_quadtree(spark, d), PIX_BOUNDS)
    return s.withColumns({c: F.round(c, 6) for c in ("unique_coverage_m2", "coverage_ratio", "min_m2", "max_m2", "mean_m2")})


# Scalar functions


@query("SELECT l_orderkey AS k, l_linenumber AS n, round(623422.47::DOUBLE + CAST(l_partkey AS DOUBLE) * 0.01::DOUBLE, 6) AS x, round(4678756.5::DOUBLE + CAST(l_suppkey AS DOUBLE) * (-0.01)::DOUBLE, 6) AS y FROM lineitem")
def pixel_to_world(spark, d):
    x, y = geo.pixel_to_world(GT, F.col("l_partkey"), F.col("l_suppkey"))
    return spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.round(x, 6).alias("x"), F.round(y, 6).alias("y"))


@query(f"WITH {_PTS} SELECT ord, greatest(0, least(CAST(trunc(x / 80.0 * 640.0) AS BIGINT), 639)) AS px, greatest(0, least(CAST(trunc((64.0 - y) / 64.0 * 512.0) AS BIGINT), 511)) AS py FROM pts")
def world_to_pixel(spark, d):
    px, py = geo.world_to_pixel(PIX_BOUNDS, fx.WIDTH, fx.HEIGHT, F.col("x"), F.col("y"))
    return fx.frame(spark, d, fx.POINTS).select("ord", px.alias("px"), py.alias("py"))


@query(f"WITH {_DET} SELECT det_idx, greatest(623422.0, xmin - 1.5) AS xmin, greatest(4678530.0, ymin - 1.5) AS ymin, least(623722.0, xmax + 1.5) AS xmax, least(4678780.0, ymax + 1.5) AS ymax FROM det")
def expand_bounds(spark, d):
    b = geo.expand_bounds(geo.Box.of(), 3.0, (623422.0, 4678530.0, 623722.0, 4678780.0))
    return _detections(spark, d).select("det_idx", b.xmin.alias("xmin"), b.ymin.alias("ymin"), b.xmax.alias("xmax"), b.ymax.alias("ymax"))


@query("WITH t AS (SELECT o_orderkey, 'tile' || repeat('_1', CAST(1 + o_orderkey % 4 AS INTEGER)) AS tile_id FROM orders) SELECT o_orderkey, tile_id, CAST(length(tile_id) - length(replace(tile_id, '_', '')) - 1 AS INTEGER) AS level FROM t")
def quadtree_level(spark, d):
    t = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", F.concat(F.lit("tile"), F.expr("repeat('_1', cast(1 + o_orderkey % 4 as int))")).alias("tile_id"))
    return t.select("o_orderkey", "tile_id", geo.quadtree_level(F.col("tile_id")).alias("level"))


@query("SELECT p_partkey, CAST(CASE WHEN p_size <= 1 THEN 0 WHEN p_size <= 2 THEN 1 WHEN p_size <= 3 THEN 2 WHEN p_size <= 5 THEN 3 WHEN p_size <= 10 THEN 4 ELSE 5 END AS INTEGER) AS class FROM part")
def cluster_class(spark, d):
    return spark.read.parquet(f"{d}/part.parquet").select("p_partkey", geo.cluster_class(F.col("p_size")).alias("class"))


@query("""WITH h AS (SELECT p_partkey, (p_partkey * 0.618033988749895::DOUBLE) % 1.0 AS hue FROM part), s AS (SELECT *, CAST(floor(hue * 6.0) AS INTEGER) AS k, hue * 6.0 - floor(hue * 6.0) AS f FROM h),
c AS (SELECT p_partkey, hue, k, 0.8::DOUBLE AS v, 0.32::DOUBLE AS p, 0.8 * (1.0 - 0.6 * f) AS q, 0.8 * (1.0 - 0.6 * (1.0 - f)) AS t FROM s)
SELECT p_partkey, round(hue, 6) AS hue, round(CASE k WHEN 0 THEN v WHEN 1 THEN q WHEN 2 THEN p WHEN 3 THEN p WHEN 4 THEN t ELSE v END, 6) AS r,
round(CASE k WHEN 0 THEN t WHEN 1 THEN v WHEN 2 THEN v WHEN 3 THEN q ELSE p END, 6) AS g, round(CASE k WHEN 0 THEN p WHEN 1 THEN p WHEN 2 THEN t WHEN 3 THEN v WHEN 4 THEN v ELSE q END, 6) AS b FROM c""")
def golden_hue(spark, d):
    r, g, b = points.object_colors(F.col("p_partkey"))
    return spark.read.parquet(f"{d}/part.parquet").select("p_partkey", F.round(geo.golden_hue(F.col("p_partkey")), 6).alias("hue"), F.round(r, 6).alias("r"), F.round(g, 6).alias("g"), F.round(b, 6).alias("b"))


# Masks


def _masks(spark, d):
    return fx.frame(spark, d, fx.MASKS_SPARK).withColumn("rle_mask", rle.encode(F.col("pixels"), F.lit(8), F.lit(8)))


_RUNS = f"""{_MSK}, cell AS (SELECT vec_id, unnest(pixels) AS v, unnest(range(64)) AS i FROM msk), mark AS (SELECT *, CASE WHEN v = lag(v) OVER (PARTITION BY vec_id ORDER BY i) THEN 0 ELSE 1 END AS b FROM cell),
run AS (SELECT vec_id, g, min(v) AS v, count(*) AS n FROM (SELECT *, sum(b) OVER (PARTITION BY vec_id ORDER BY i) AS g FROM mark) q GROUP BY vec_id, g)"""


@query(f"WITH {_RUNS} SELECT vec_id, CASE WHEN min_by(v, g) = 1 THEN '0,' ELSE '' END || string_agg(CAST(n AS VARCHAR), ',' ORDER BY g) AS counts FROM run GROUP BY vec_id")
def rle_encode(spark, d):
    return _masks(spark, d).select("vec_id", F.concat_ws(",", F.col("rle_mask.counts").cast("array<string>")).alias("counts"))


@query(f"WITH {_MSK} SELECT vec_id, array_to_string(list_transform(pixels, lambda v: v * 255), ',') AS decoded, array_to_string(list_transform(pixels, lambda v: CASE WHEN pixels[1] = 1 THEN 255 - v * 255 ELSE v * 255 END), ',') AS decoded_legacy FROM msk")
def rle_decode(spark, d):
    m = _masks(spark, d).withColumn("old", rle.encode(F.col("pixels"), F.lit(8), F.lit(8), legacy=True))
    text = lambda c: F.concat_ws(",", rle.decode(F.col(c)).cast("array<string>"))
    return m.select("vec_id", text("rle_mask").alias("decoded"), text("old").alias("decoded_legacy"))


_FEAT = f"""{_MSK}, cell AS (SELECT vec_id, unnest(pixels) AS v, unnest(range(64)) AS i FROM msk), feat AS (SELECT vec_id, count(*) AS area, CAST(trunc(sum(i % 8) / count(*)::DOUBLE) AS INTEGER) AS cx, CAST(trunc(sum(i // 8) / count(*)::DOUBLE) AS INTEGER) AS cy,
 CAST(min(i % 8) AS INTEGER) AS xmin, CAST(min(i // 8) AS INTEGER) AS ymin, CAST(max(i % 8) + 1 AS INTEGER) AS xmax, CAST(max(i // 8) + 1 AS INTEGER) AS ymax FROM cell WHERE v = 1 GROUP BY vec_id)"""


@query(f"WITH {_FEAT} SELECT * FROM feat")
def mask_features(spark, d):
    return _masks(spark, d).withColumn("f", rle.features(F.col("rle_mask"))).where("f IS NOT NULL").select("vec_id", "f.*")


_MGT = geo.Geotransform(0.0, 0.25, 0.0, 0.0, 0.0, -0.25)
_MEASURED = f"""{_FEAT}, meas AS (SELECT vec_id, area * 0.0625::DOUBLE AS area_m2, sqrt(4.0 * (area * 0.0625::DOUBLE) / pi()) AS dia, cx * 0.25::DOUBLE AS wx, cy * -0.25::DOUBLE AS wy FROM feat)"""


def _measured(spark, d, least=0.0):
    return detect.measured(_masks(spark, d).withColumn("x0", F.lit(0)).withColumn("y0", F.lit(0)), _MGT, least)


@query(f"WITH {_MEASURED} SELECT vec_id, area_m2, round(dia, 6) AS equivalent_diameter_m, wx AS cx, wy AS cy FROM meas WHERE dia >= 1.6")
def diameter_filter(spark, d):
    return _measured(spark, d, 1.6).select("vec_id", "area_m2", F.round("equivalent_diameter_m", 6).alias("equivalent_diameter_m"), (F.col("cx") + 0.0).alias("cx"), (F.col("cy") + 0.0).alias("cy"))


@query(f"WITH {_MEASURED} SELECT count(*) AS detection_count, min(area_m2) AS area_min, max(area_m2) AS area_max, round(avg(area_m2), 6) AS area_mean, round(min(dia), 6) AS diameter_min, round(max(dia), 6) AS diameter_max, round(avg(dia), 6) AS diameter_mean FROM meas")
def detection_summary(spark, d):
    return detect.summary(_measured(spark, d)).withColumns({c: F.round(c, 6) for c in ("area_mean", "diameter_min", "diameter_max", "diameter_mean")})


# Pairs, graphs, fusion

_IOU = "CASE WHEN least(a.xmax, b.xmax) - greatest(a.xmin, b.xmin) > 0 AND least(a.ymax, b.ymax) - greatest(a.ymin, b.ymin) > 0 THEN (least(a.xmax, b.xmax) - greatest(a.xmin, b.xmin)) * (least(a.ymax, b.ymax) - greatest(a.ymin, b.ymin)) / ((a.xmax - a.xmin) * (a.ymax - a.ymin) + (b.xmax - b.xmin) * (b.ymax - b.ymin) - (least(a.xmax, b.xmax) - greatest(a.xmin, b.xmin)) * (least(a.ymax, b.ymax) - greatest(a.ymin, b.ymin))) ELSE 0.0::DOUBLE END"
_DIST = "sqrt((a.cx - b.cx) * (a.cx - b.cx) + (a.cy - b.cy) * (a.cy - b.cy))"
_TOUCH = "a.xmin <= b.xmax AND b.xmin <= a.xmax AND a.ymin <= b.ymax AND b.ymin <= a.ymax"


def _pairs(radius: float, where: str) -> str:
    """Pairs by cells, so that the check itself isn't a nested loop."""
    r = f"{radius}::DOUBLE"
    return f"""cell AS (SELECT *, floor(cx / {r}) AS gx, floor(cy / {r}) AS gy FROM det), near AS (SELECT c.* EXCLUDE (gx, gy), c.gx + dx AS gx, c.gy + dy AS gy FROM cell c CROSS JOIN (SELECT unnest([-1, 0, 1]) AS dx) p CROSS JOIN (SELECT unnest([-1, 0, 1]) AS dy) q),
pair AS (SELECT a.det_idx AS src, b.det_idx AS dst, a.source_patch_id = b.source_patch_id AS same, {_DIST} AS dist, {_IOU} AS iou FROM cell a JOIN near b ON a.gx = b.gx AND a.gy = b.gy AND a.det_idx < b.det_idx WHERE {_DIST} <= {radius} AND {where})"""


_HEDGE = f"{_DET}, {_pairs(0.8, f'{_TOUCH} AND a.source_patch_id <> b.source_patch_id')}, edge AS (SELECT src, dst, iou FROM pair WHERE iou >= 0.3)"
_AEDGE = f"{_DET}, {_pairs(3.5, _TOUCH)}, weighed AS (SELECT src, dst, exp(-(dist * dist) / (2.0 * 0.7 * 0.7)::DOUBLE) * (1.0 + 0.3 * iou) * CASE WHEN same THEN 1.2::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM pair), edge AS (SELECT src, dst, weight FROM weighed WHERE weight >= 0.45)"


@query(f"WITH {_DET}, {_pairs(3.5, _TOUCH)} SELECT src, dst, round(dist, 6) AS dist, round(iou, 6) AS iou FROM pair")
def bbox_iou_pairs(spark, d):
    a, b = geo.Box.of("a_"), geo.Box.of("b_")
    p = spatial_join.pairs_within(_detections(spark, d).drop("score"), 3.5).where(geo.boxes_touch(a, b))
    return p.select(F.col("a_det_idx").alias("src"), F.col("b_det_idx").alias("dst"), F.round("dist", 6).alias("dist"), F.round(geo.iou(a, b), 6).alias("iou"))


@query(f"WITH {_HEDGE} SELECT src, dst, round(iou, 6) AS iou FROM edge")
def heuristic_edges(spark, d):
    return spatial_join.heuristic_edges(_detections(spark, d)).withColumn("iou", F.round("iou", 6))


@query(f"WITH {_AEDGE} SELECT src, dst, round(weight, 6) AS weight FROM edge")
def affinity_edges(spark, d):
    return spatial_join.affinity_edges(_detections(spark, d)).withColumn("weight", F.round("weight", 6))


_COMP = f"""WITH RECURSIVE {_HEDGE}, link AS (SELECT src AS u, dst AS v FROM edge UNION SELECT dst, src FROM edge), reach AS (SELECT u AS node, u AS r FROM link UNION SELECT link.v, reach.r FROM reach JOIN link ON link.u = reach.node),
comp AS (SELECT node, min(r) AS component FROM reach GROUP BY node), lab AS (SELECT det_idx, coalesce(component, det_idx) AS label FROM det LEFT JOIN comp ON node = det_idx)"""


@query(f"{_COMP} SELECT node, component FROM comp")
def connected_components(spark, d):
    return graph.connected_components(spark, spatial_join.heuristic_edges(_detections(spark, d)).select("src", "dst"))


_STONE = """stone AS (SELECT label, count(*) AS source_detection_count, count(DISTINCT source_patch_id) AS source_patches_span, round(avg(score), 6) AS score_mean, max(score) AS score_max, min(xmin) AS xmin, min(ymin) AS ymin, max(xmax) AS xmax, max(ymax) AS ymax,
 string_agg(CAST(det_idx AS VARCHAR), ',' ORDER BY det_idx) AS members FROM det JOIN lab USING (det_idx) GROUP BY label)"""
_LISTED = ("label", "source_detection_count", "source_patches_span", "score_mean", "score_max", "xmin", "ymin", "xmax", "ymax", "members")


def _stones(spark, d, method):
    det = _detections(spark, d)
    return fuse.stones(det, fuse.labels(spark, det, method), method)


def _listed(found):
    return found.withColumn("members", F.concat_ws(",", F.col("detection_indices").cast("array<string>"))).withColumn("score_mean", F.round("score_mean", 6)).select(*_LISTED)


@query(f"{_COMP}, {_STONE} SELECT {', '.join(_LISTED)} FROM stone")
def heuristic_stones(spark, d):
    return _listed(_stones(spark, d, "heuristic"))


# Pivots: per node the smaller neighbours; in each (small) component the nodes are walked in order.
_PIVOT = f"""WITH RECURSIVE {_AEDGE}, link AS (SELECT src AS u, dst AS v FROM edge UNION SELECT dst, src FROM edge), reach AS (SELECT u AS node, u AS r FROM link UNION SELECT link.v, reach.r FROM reach JOIN link ON link.u = reach.node),
comp AS (SELECT node, min(r) AS c FROM reach GROUP BY node), low AS (SELECT dst AS node, list(src) AS nb FROM edge GROUP BY dst),
walk AS (SELECT c, list_reduce(list({{'id': node, 'nb': coalesce(nb, [])}} ORDER BY node), lambda acc, x: CASE WHEN list_has_any(acc.nb, x.nb) THEN acc ELSE {{'id': x.id, 'nb': list_append(acc.nb, x.id)}} END, {{'id': CAST(-1 AS BIGINT), 'nb': CAST([] AS BIGINT[])}}).nb AS pivots FROM comp LEFT JOIN low USING (node) GROUP BY c),
lab AS (SELECT det_idx, CASE WHEN c IS NULL OR list_contains(pivots, det_idx) THEN det_idx ELSE list_min(list_intersect(nb, pivots)) END AS label FROM det LEFT JOIN comp ON node = det_idx LEFT JOIN walk USING (c) LEFT JOIN low ON low.node = det_idx)"""


@query(f"{_PIVOT} SELECT det_idx, label FROM lab")
def pivot_clusters(spark, d):
    return fuse.correlation_labels(spark, _detections(spark, d))


@query(f"{_PIVOT}, {_STONE} SELECT {', '.join(_LISTED)} FROM stone")
def correlation_stones(spark, d):
    return _listed(_stones(spark, d, "correlation_clustering"))


_SUMMARY = "count(*) AS output_stones, round(1.0 - count(*) / greatest(sum(source_detection_count), 1)::DOUBLE, 6) AS merge_ratio, min(source_detection_count) AS min_group, max(source_detection_count) AS max_group, round(avg(source_detection_count), 6) AS mean_group"


@query(f"{_PIVOT}, {_STONE} SELECT 'sahi' AS source, 'correlation_clustering' AS method, CAST(sum(source_detection_count) AS BIGINT) AS input_detections, {_SUMMARY} FROM stone")
def fusion_summary(spark, d):
    return fuse.fusion_summary(_stones(spark, d, "correlation_clustering"), "sahi", "correlation_clustering").withColumns({c: F.round(c, 6) for c in ("merge_ratio", "mean_group")})


@query(f"""SELECT * FROM ({_COMP}, {_STONE} SELECT 'sahi' AS source, count(*) AS a_output_stones, round(1.0 - count(*) / sum(source_detection_count)::DOUBLE, 6) AS a_merge_ratio, max(source_detection_count) AS a_max_group FROM stone) a
FULL OUTER JOIN ({_PIVOT}, {_STONE} SELECT 'sahi' AS source, count(*) AS b_output_stones, round(1.0 - count(*) / sum(source_detection_count)::DOUBLE, 6) AS b_merge_ratio, max(source_detection_count) AS b_max_group FROM stone) b USING (source)""")
def fusion_compare(spark, d):
    one = lambda m: fuse.fusion_summary(_stones(spark, d, m), "sahi", m)
    return fuse.compare(one("heuristic"), one("correlation_clustering")).withColumns({c: F.round(c, 6) for c in ("a_merge_ratio", "b_merge_ratio")})


@query(f"{_COMP} SELECT label, det_idx, score, source_patch_id FROM det JOIN lab USING (det_idx)")
def stone_members(spark, d):
    return fuse.members(_stones(spark, d, "heuristic"), _detections(spark, d)).select("label", "det_idx", "score", "source_patch_id")


# Points


@query(f"WITH {_PTS} SELECT ord, x, y, z FROM pts WHERE ord % greatest(1, (SELECT count(*) FROM pts) // 300) = 0")
def stride_sample(spark, d):
    return points.stride_sample(fx.frame(spark, d, fx.POINTS), 300)


@query(f"""WITH {_CLD}, low AS (SELECT min(x) - 0.25 AS x0, min(y) - 0.25 AS y0, min(z) - 0.25 AS z0 FROM cld) SELECT CAST(floor((x - x0) / 0.5) AS BIGINT) AS vx, CAST(floor((y - y0) / 0.5) AS BIGINT) AS vy, CAST(floor((z - z0) / 0.5) AS BIGINT) AS vz,
sum(x) / count(*) AS x, sum(y) / count(*) AS y, count(*) AS n FROM cld CROSS JOIN low GROUP BY ALL""")
def voxel_downsample(spark, d):
    return points.voxel_downsample(fx.frame(spark, d, fx.CLOUDS), 0.5).drop("z")  # x and y are whole multiples of 1/128: sums are exact, so means are equal


def _polygons(spark, d):
    o = fx.frame(spark, d, fx.OBJECTS)
    x0, y0, x1, y1 = (F.col(c) for c in ("x0", "y0", "x1", "y1"))
    dx, dy = (x1 - x0) / 4, (y1 - y0) / 4
    corners = [(x0 + dx, y0), (x1 - dx, y0), (x1, y0 + dy), (x1, y1 - dy), (x1 - dx, y1), (x0 + dx, y1), (x0, y1 - dy), (x0, y0 + dy)]
    return o.select(F.col("obj").alias("si"), F.array(*[F.struct(x.cast("float").alias("x"), y.cast("float").alias("y")) for x, y in corners]).alias("polygon"))


_INSIDE = f"""{_DET}, {_OBJ}, {_PTS}, vert AS (SELECT obj, k, CASE k WHEN 0 THEN x0 + (x1 - x0) / 4 WHEN 1 THEN x1 - (x1 - x0) / 4 WHEN 2 THEN x1 WHEN 3 THEN x1 WHEN 4 THEN x1 - (x1 - x0) / 4 WHEN 5 THEN x0 + (x1 - x0) / 4 ELSE x0 END::FLOAT::DOUBLE AS vx,
 CASE k WHEN 0 THEN y0 WHEN 1 THEN y0 WHEN 2 THEN y0 + (y1 - y0) / 4 WHEN 3 THEN y1 - (y1 - y0) / 4 WHEN 4 THEN y1 WHEN 5 THEN y1 WHEN 6 THEN y1 - (y1 - y0) / 4 ELSE y0 + (y1 - y0) / 4 END::FLOAT::DOUBLE AS vy FROM obj CROSS JOIN (SELECT unnest(range(8)) AS k) q),
side AS (SELECT a.obj, a.vx AS px, a.vy AS py, b.vx AS qx, b.vy AS qy FROM vert a JOIN vert b ON a.obj = b.obj AND b.k = (a.k + 1) % 8),
cand AS (SELECT ord, obj, x::FLOAT::DOUBLE AS x, y::FLOAT::DOUBLE AS y FROM pts JOIN obj ON x::FLOAT BETWEEN (x0 - 0.5)::FLOAT AND (x1 + 0.5)::FLOAT AND y::FLOAT BETWEEN (y0 - 0.5)::FLOAT AND (y1 + 0.5)::FLOAT),
walked AS (SELECT ord, obj, sum(CASE WHEN (py > y) <> (qy > y) AND (CASE WHEN qy > py THEN (qx - px) * (y - py) - (qy - py) * (x - px) > 0 ELSE (qx - px) * (y - py) - (qy - py) * (x - px) < 0 END) THEN 1 ELSE 0 END) AS cross_n,
  max(CASE WHEN (qx - px) * (y - py) - (qy - py) * (x - px) = 0 AND x BETWEEN least(px, qx) AND greatest(px, qx) AND y BETWEEN least(py, qy) AND greatest(py, qy) THEN 1 ELSE 0 END) AS edge_n FROM cand JOIN side USING (obj) GROUP BY ord, obj),
hit AS (SELECT ord, min(obj) AS si FROM walked WHERE cross_n % 2 = 1 OR edge_n = 1 GROUP BY ord)"""


@query(f"WITH {_INSIDE} SELECT ord, si FROM hit")
def point_in_polygon(spark, d):
    return spatial_join.points_in_objects(fx.frame(spark, d, fx.POINTS), _polygons(spark, d))


_PAL = ", ".join("'" + ",".join(str(c) for c in rgb) + "'" for rgb in geo.PALETTE)


@query(f"WITH {_INSIDE} SELECT ord, x, y, z, si, coalesce([{_PAL}][CAST(si % 12 + 1 AS INTEGER)], '0.6,0.6,0.6') AS color FROM pts LEFT JOIN hit USING (ord)")
def points_colored(spark, d):
    c = points.colored(fx.frame(spark, d, fx.POINTS), _polygons(spark, d))
    return c.select("ord", "x", "y", "z", "si", F.concat_ws(",", F.col("color").cast("array<string>")).alias("color"))


@query(f"WITH {_INSIDE} SELECT count(*) AS total, count(si) AS matched, count(*) - count(si) AS unmatched FROM pts LEFT JOIN hit USING (ord)")
def overview_counts(spark, d):
    return points.overview_counts(points.colored(fx.frame(spark, d, fx.POINTS), _polygons(spark, d)))


@query(f"""WITH {_CLD}, st AS (SELECT stone, count(*) AS point_count, min(x) AS xl, max(x) AS xh, min(y) AS yl, max(y) AS yh, min(z) AS zl, max(z) AS zh, quantile_cont(z, 0.05) AS ground_z FROM cld GROUP BY stone),
g AS (SELECT *, CAST(greatest(1, ceil((xh - xl) / 0.1::DOUBLE)) AS BIGINT) AS grid_nx, CAST(greatest(1, ceil((yh - yl) / 0.1::DOUBLE)) AS BIGINT) AS grid_ny FROM st),
c AS (SELECT stone, least(floor((x - xl) / 0.1::DOUBLE), grid_nx - 1) AS gx, least(floor((y - yl) / 0.1::DOUBLE), grid_ny - 1) AS gy, max(z) AS top, max(ground_z) AS ground FROM cld JOIN g USING (stone) GROUP BY ALL),
v AS (SELECT stone, sum(greatest(top - ground, 0.0)) * (0.1::DOUBLE * 0.1::DOUBLE) AS v, count(*) * (0.1::DOUBLE * 0.1::DOUBLE) AS s FROM c GROUP BY stone)
SELECT stone, CASE WHEN point_count < 4 OR zh - zl < 0.1 THEN 0.0 ELSE round(v, 6) END AS volume_m3, CASE WHEN point_count < 4 OR zh - zl < 0.1 THEN 0.0 ELSE round(s, 6) END AS surface_area_m2, point_count, grid_nx, grid_ny, round(ground_z, 6) AS ground_z,
CASE WHEN point_count < 4 THEN 'too few points' WHEN zh - zl < 0.1 THEN 'flat' ELSE '' END AS note FROM g JOIN v USING (stone)""")
def grid_volume(spark, d):
    v = volume.compute_volume(fx.frame(spark, d, fx.CLOUDS), ["stone"], "grid_2d5")
    return v.withColumns({c: F.round(c, 6) for c in ("volume_m3", "surface_area_m2", "ground_z")})


@query(f"WITH {_CLD} SELECT stone, count(*) AS n, round(avg(x), 6) AS cx, max(x) - min(x) AS dx, round(avg(y), 6) AS cy, max(y) - min(y) AS dy, round(avg(z), 6) AS cz, max(z) - min(z) AS dz FROM cld GROUP BY stone")
def cloud_extent(spark, d):
    return points.extents(fx.frame(spark, d, fx.CLOUDS), ["stone"]).withColumns({c: F.round(c, 6) for c in ("cx", "cy", "cz")})


@query(f"WITH {_CLD} SELECT round(avg(cx), 6) AS cx, round(avg(cy), 6) AS cy, round(avg(cz), 6) AS cz, count(*) AS n_clouds FROM (SELECT stone, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz FROM cld GROUP BY stone) q")
def scene_center(spark, d):
    return points.scene_center(points.extents(fx.frame(spark, d, fx.CLOUDS), ["stone"])).withColumns({c: F.round(c, 6) for c in ("cx", "cy", "cz")})


# Statistics

_OK = f"{_MEA}, ok AS (SELECT * FROM mea WHERE equivalent_diameter_m > 0 AND volume_m3 >= 0)"


def _ok(spark, d):
    return stats.valid(stats.measures(fx.frame(spark, d, fx.MEASURES)))


def _six(name: str, c: str, where: str) -> str:
    fns = (("min", "min({c})"), ("max", "max({c})"), ("mean", "avg({c})"), ("median", "quantile_cont({c}, 0.5)"), ("std", "stddev_pop({c})"), ("total", "sum({c})"))
    return ", ".join(f"round(coalesce({f.format(c=c)} FILTER (WHERE {where}), 0.0), 6) AS {name}_{n}" for n, f in fns)


@query(f"WITH {_OK} SELECT count(*) AS n, {_six('diameter', 'equivalent_diameter_m', 'equivalent_diameter_m > 0')}, {_six('volume', 'volume_m3', 'volume_m3 >= 0')}, {_six('area', 'area_m2', 'area_m2 > 0')} FROM ok")
def stone_statistics(spark, d):
    s = stats.describe(_ok(spark, d))
    return s.withColumns({c: F.round(c, 6) for c in s.columns if c != "n"})


_BUCKETS = ", ".join(f"('{n}', {lo}::DOUBLE, {hi}::DOUBLE)" for n, lo, hi in stats.BUCKETS)


@query(f"WITH {_OK}, b(label, lo, hi) AS (VALUES {_BUCKETS}) SELECT label, count(equivalent_diameter_m) AS n, round(100.0 * count(equivalent_diameter_m) / greatest((SELECT count(*) FROM ok), 1)::DOUBLE, 6) AS pct FROM b LEFT JOIN ok ON equivalent_diameter_m >= lo AND equivalent_diameter_m < hi GROUP BY label")
def size_buckets(spark, d):
    return stats.size_buckets(spark, _ok(spark, d)).withColumn("pct", F.round("pct", 6))


@query(f"""WITH {_OK}, e AS (SELECT min(equivalent_diameter_m) AS lo, max(equivalent_diameter_m) AS hi FROM ok), c AS (SELECT least(CAST(floor((equivalent_diameter_m - lo) / (hi - lo) * 10.0) AS BIGINT) + 1, 10) AS bin, count(*) AS n FROM ok CROSS JOIN e GROUP BY ALL)
SELECT bin, round(lo + (bin - 1) * ((hi - lo) / 10.0), 6) AS lo, round(lo + bin * ((hi - lo) / 10.0), 6) AS hi, coalesce(n, 0) AS n FROM e CROSS JOIN (SELECT unnest(range(1, 11)) AS bin) q LEFT JOIN c USING (bin)""")
def histogram(spark, d):
    return stats.histogram(_ok(spark, d), "equivalent_diameter_m").withColumns({c: F.round(c, 6) for c in ("lo", "hi")})


@query(f"""WITH {_OK}, q AS (SELECT quantile_cont(volume_m3, 0.25) AS q1, quantile_cont(volume_m3, 0.5) AS median, quantile_cont(volume_m3, 0.75) AS q3 FROM ok), t AS (SELECT volume_m3 AS v, q.*, volume_m3 BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS fit FROM ok CROSS JOIN q)
SELECT q1, median, q3, min(v) FILTER (WHERE fit) AS whisker_lo, max(v) FILTER (WHERE fit) AS whisker_hi, count(*) FILTER (WHERE NOT fit) AS outliers FROM t GROUP BY q1, median, q3""")
def boxplot_stats(spark, d):
    return stats.boxplot(_ok(spark, d), "volume_m3")


@query(f"WITH {_OK} SELECT row_number() OVER w AS rank, stone_id, equivalent_diameter_m, volume_m3, sum(volume_m3) OVER (w ROWS UNBOUNDED PRECEDING) AS running, round(100.0 * sum(volume_m3) OVER (w ROWS UNBOUNDED PRECEDING) / sum(volume_m3) OVER (), 6) AS pct FROM ok WINDOW w AS (ORDER BY equivalent_diameter_m DESC, stone_id)")
def cumulative_volume(spark, d):
    return stats.cumulative_volume(_ok(spark, d)).withColumn("pct", F.round("pct", 6))


@query(f"WITH {_OK} SELECT count(*) AS n, {', '.join(f'round(sum(pow(equivalent_diameter_m, {k})), 4) AS x{k}' for k in range(1, 7))}, {', '.join(f'round(sum(pow(equivalent_diameter_m, {k}) * volume_m3), 4) AS x{k}y' for k in range(4))} FROM ok")
def cubic_fit_sums(spark, d):
    s = stats.cubic_sums(_ok(spark, d))
    return s.withColumns({c: F.round(c, 4) for c in s.columns if c != "n"})


# Shapes with known answers

_SIDES = "1 + p_size / 16.0::DOUBLE AS a, 1 + (p_partkey % 7) / 8.0::DOUBLE AS b, 0.5 + (p_partkey % 5) / 4.0::DOUBLE AS c"


@query(f"SELECT p_partkey, round(a * b * c, 6) AS volume_m3, round(2 * (a * b + b * c + a * c), 6) AS surface_area_m2, CAST(9 AS BIGINT) AS point_count, 'convex_hull' AS method FROM (SELECT p_partkey, {_SIDES} FROM part) q")
def hull_volume(spark, d):
    box = spark.read.parquet(f"{d}/part.parquet").select("p_partkey", (1 + F.col("p_size") / 16).alias("a"), (1 + F.col("p_partkey") % 7 / 8).alias("b"), (0.5 + F.col("p_partkey") % 5 / 4).alias("c"))
    corners = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(k).alias("k")) for i in (0.0, 1.0) for j in (0.0, 1.0) for k in (0.0, 1.0)], F.struct(F.lit(0.5).alias("i"), F.lit(0.5).alias("j"), F.lit(0.25).alias("k")))
    pts = box.withColumn("t", F.explode(corners)).select("p_partkey", (F.col("a") * F.col("t.i")).alias("x"), (F.col("b") * F.col("t.j")).alias("y"), (F.col("c") * F.col("t.k")).alias("z"))
    return volume.compute_volume(pts, ["p_partkey"], "convex_hull").select("p_partkey", F.round("volume_m3", 6).alias("volume_m3"), F.round("surface_area_m2", 6).alias("surface_area_m2"), "point_count", "method")


_RECT = "1 + p_partkey % 3 AS x0, 1 + p_partkey % 4 AS y0, 3 + p_size % 5 AS w, 3 + p_partkey % 6 AS h"


@query(f"SELECT p_partkey, 4 AS vertices, x0 * 0.125::DOUBLE AS ax, 64.0::DOUBLE - (y0 + h - 1) * 0.125::DOUBLE AS ay, (x0 + w - 1) * 0.125::DOUBLE AS bx, 64.0::DOUBLE - y0 * 0.125::DOUBLE AS by FROM (SELECT p_partkey, {_RECT} FROM part) q")
def mask_polygon(spark, d):
    r = spark.read.parquet(f"{d}/part.parquet").selectExpr("p_partkey", *[x.strip() for x in _RECT.split(",")])
    on = lambda i: (F.pmod(i, F.lit(12)) >= F.col("x0")) & (F.pmod(i, F.lit(12)) < F.col("x0") + F.col("w")) & (F.floor(i / 12) >= F.col("y0")) & (F.floor(i / 12) < F.col("y0") + F.col("h"))
    m = r.withColumn("pixels", F.transform(F.sequence(F.lit(0), F.lit(143)), lambda i: F.when(on(i), 1).otherwise(0)))
    m = m.select("p_partkey", rle.encode(F.col("pixels"), F.lit(12), F.lit(12)).alias("rle_mask"), F.array(F.lit(0), F.lit(0)).alias("pixel_origin"))
    corner = lambda i, c: F.get(F.array_sort("polygon"), F.lit(i))[c].cast("double")  # noqa: E731  by x, then y
    return vision.mask_polygons(m, PIX_GT).select("p_partkey", F.size("polygon").alias("vertices"), corner(0, "x").alias("ax"), corner(0, "y").alias("ay"), corner(3, "x").alias("bx"), corner(3, "y").alias("by"))


# Files


@query(f"WITH {_CLD} SELECT x, y, CAST(stone AS DOUBLE) AS z FROM cld")
def las_points(spark, d):
    folder = session.scratch(spark, "las")
    cloud = fx.frame(spark, d, fx.CLOUDS).select("x", "y", F.col("stone").alias("z"))
    files = [r["file"] for r in las.write(cloud.repartition(3), folder, 1 / 128).collect()]  # a row a file
    return las.points(spark, sorted(files), range_points=4096).select("x", "y", "z")


def _raster(spark) -> str:
    """The pixel fixture as a TIFF file in the shared folder."""
    import numpy as np
    from pyarrow import fs

    py, px = np.mgrid[0 : fx.HEIGHT, 0 : fx.WIDTH]
    v = np.where((px // 128 + py // 128) % 5 == 0, 0, (px * 31 + py * 17 + (px // 64) * (py // 64) * 7) % 256).astype(np.uint8)
    path = session.scratch(spark, "raster") + ".tif"
    where, at = fs.FileSystem.from_uri(path)
    where.create_dir(at.rpartition("/")[0], recursive=True)
    with where.open_output_stream(at) as f:
        f.write(raster.encoded(v[:, :, None]))
    return path


@query(f"WITH {_PIX} SELECT CAST(px // 64 * 64 AS INTEGER) AS x, CAST(py // 64 * 64 AS INTEGER) AS y, count(*) AS pixels, CAST(sum(v) AS BIGINT) AS total, CAST(sum(v * (px % 64 + 64 * (py % 64))) AS BIGINT) AS placed FROM pix GROUP BY 1, 2")
def raster_blocks(spark, d):
    px = raster.pixels(raster.blocks(spark, _raster(spark))).withColumn("v", F.get("bands", F.lit(0)).cast("long"))
    at = lambda c: (F.floor(F.col(c) / 64) * 64).cast("int")
    return px.groupBy(at("px").alias("x"), at("py").alias("y")).agg(F.count("*").alias("pixels"), F.sum("v").alias("total"), F.sum(F.col("v") * (F.col("px") % 64 + 64 * (F.col("py") % 64))).alias("placed"))


@query("SELECT 640 AS width, 512 AS height, 1 AS bands, 0.125::DOUBLE AS resolution, 0.0::DOUBLE AS xmin, 0.0::DOUBLE AS ymin, 80.0::DOUBLE AS xmax, 64.0::DOUBLE AS ymax")
def raster_metadata(spark, d):
    return raster.metadata(spark, _raster(spark), PIX_GT)


@query(f"WITH {_PIX} SELECT CAST(px // 4 AS BIGINT) AS px, CAST(py // 4 AS BIGINT) AS py, avg(v) AS v, 0.25::DOUBLE AS scale FROM pix GROUP BY 1, 2")
def raster_downscaled(spark, d):
    small, scale = raster.downscaled(spark, _raster(spark), 160)
    return small.select("px", "py", F.get("bands", F.lit(0)).alias("v"), F.lit(scale).alias("scale"))


@query(f"{_COMP}, {_STONE} SELECT label, source_detection_count, source_patches_span, max(label) OVER () AS top FROM stone")
def stage_files(spark, d):
    found = _stones(spark, d, "heuristic")
    folder = session.scratch(spark, "stage")
    report.write_stage(folder, found.agg(F.max("label").alias("top")), stones=found)
    stones = spark.read.parquet(f"{folder}/stones").select("label", "source_detection_count", "source_patches_span")
    return stones.crossJoin(F.broadcast(report.read_summary(spark, folder, "top long")))


# Overlay and report rows

_OVER = "least(CAST(trunc(xmin / 0.125 * 0.5) AS BIGINT), CAST(trunc(xmax / 0.125 * 0.5) AS BIGINT)) AS x0, least(CAST(trunc((ymin - 64.0) / -0.125 * 0.5) AS BIGINT), CAST(trunc((ymax - 64.0) / -0.125 * 0.5) AS BIGINT)) AS y0, greatest(CAST(trunc(xmin / 0.125 * 0.5) AS BIGINT), CAST(trunc(xmax / 0.125 * 0.5) AS BIGINT)) AS x1, greatest(CAST(trunc((ymin - 64.0) / -0.125 * 0.5) AS BIGINT), CAST(trunc((ymax - 64.0) / -0.125 * 0.5) AS BIGINT)) AS y1"


@query(f"WITH {_STATUS} SELECT {_OVER}, patch_id AS id, right(patch_id, 4) AS label, CASE WHEN status = 'kept' THEN '#2ecc71' ELSE '#e74c3c' END AS color FROM tiles")
def window_overlay(spark, d):
    return report.window_overlay(_status(spark, d), PIX_GT, 0.5)


@query(f"WITH {_QUADTREE} SELECT {_OVER}, tile_id AS id, 'L' || (length(tile_id) - length(replace(tile_id, '_', '')) - 1) AS label, CAST(least(length(tile_id) - length(replace(tile_id, '_', '')) - 1, 3) AS INTEGER) AS color FROM leaf WHERE NOT skipped")
def level_overlay(spark, d):
    return report.level_overlay(_quadtree(spark, d), PIX_GT, 0.5)


@query(f"WITH {_QUADTREE} SELECT {_OVER}, tile_id AS id, CAST(trunc(255.0 * edge_density / max(edge_density) OVER ()) AS INTEGER) AS color FROM leaf WHERE NOT skipped")
def density_overlay(spark, d):
    return report.density_overlay(_quadtree(spark, d), PIX_GT, 0.5).drop("label")


@query(f"""{_COMP}, {_STONE}, box AS (SELECT label AS id, source_detection_count AS members, CAST(trunc((xmin - 623422.0) / 0.125 * 0.5) AS BIGINT) AS x0, CAST(trunc((xmax - 623422.0) / 0.125 * 0.5) AS BIGINT) AS x1,
CAST(trunc((ymax - 4678780.0) / -0.125 * 0.5) AS BIGINT) AS ya, CAST(trunc((ymin - 4678780.0) / -0.125 * 0.5) AS BIGINT) AS yb FROM stone)
SELECT x0, least(ya, yb) AS y0, x1, greatest(ya, yb) AS y1, id, members, CAST(CASE WHEN members <= 1 THEN 0 WHEN members <= 2 THEN 1 WHEN members <= 3 THEN 2 WHEN members <= 5 THEN 3 WHEN members <= 10 THEN 4 ELSE 5 END AS INTEGER) AS class FROM box WHERE x1 - x0 >= 2 AND greatest(ya, yb) - least(ya, yb) >= 2""")
def fusion_overlay(spark, d):
    gt = geo.Geotransform(623422.0, 0.125, 0.0, 4678780.0, 0.0, -0.125)
    return report.fusion_overlay(_stones(spark, d, "heuristic"), gt, 0.5, "heuristic").drop("method", "color")


@query(f"""WITH {_STATUS} SELECT 'sahi' AS method, CAST(count(*) AS VARCHAR) AS total, CAST(count(*) FILTER (WHERE status = 'kept') AS VARCHAR) AS kept, CAST(count(*) FILTER (WHERE status <> 'kept') AS VARCHAR) AS skipped FROM tiles
UNION ALL SELECT * FROM (WITH {_QUADTREE} SELECT 'quadtree_dom', CAST(count(*) AS VARCHAR), CAST(count(*) FILTER (WHERE NOT skipped) AS VARCHAR), CAST(count(*) FILTER (WHERE skipped) AS VARCHAR) FROM leaf) q""")
def tiling_compare(spark, d):
    both = {"sahi": tiling.tiling_summary(_status(spark, d), fx.WIDTH, fx.HEIGHT), "quadtree_dom": tiling.quadtree_summary(_quadtree(spark, d), PIX_BOUNDS)}
    return report.compared(both).drop("coverage")


@query("""SELECT p_partkey, CAST(greatest(0, least(255, round_even(0.25 * (p_size * 5) + 0.75 * (p_partkey % 256), 0))) AS INTEGER) AS blended, p_size % 256 || ',' || p_size % 256 || ',' || p_size % 256 AS gray, p_size || ',0,255' AS held,
CAST(trunc((p_partkey * 0.5::DOUBLE - 4.0) / 0.125 * 0.5) AS BIGINT) AS px, CAST(trunc((p_size * 0.25::DOUBLE - 64.0) / -0.125 * 0.5) AS BIGINT) AS py FROM part""")
def pixel_functions(spark, d):
    p = spark.read.parquet(f"{d}/part.parquet")
    size, key = F.col("p_size").cast("int"), F.col("p_partkey").cast("int")
    px, py = geo.scaled_point(geo.Geotransform(4.0, 0.125, 0.0, 64.0, 0.0, -0.125), 0.5, key * F.lit(0.5), size * F.lit(0.25))
    text = lambda c: F.concat_ws(",", c.cast("array<string>"))
    return p.select("p_partkey", geo.blend(size * 5, key % 256, 0.25).alias("blended"), text(geo.three_channels(F.array(size))).alias("gray"), text(geo.three_channels(F.array(size, F.lit(-3), F.lit(300), F.lit(7)))).alias("held"), px.alias("px"), py.alias("py"))


# Beyond SQL


@query()
def alpha_volume(spark, d):
    return volume.compute_volume(fx.frame(spark, d, fx.CLOUDS), ["stone"], "alpha_shape", voxel_size=0.03)


@query()
def edge_map(spark, d):
    return vision.edge_map(spark, fx.frame(spark, d, fx.PIXELS), fx.WIDTH, fx.HEIGHT)
