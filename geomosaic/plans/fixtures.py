"""Deterministic relations derived from the driver's tables, as SQL that Spark and DuckDB read alike.

``DIV(a, b)`` is whole-number division; the two dialects spell it differently. All coordinates are exact in binary.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

WIDTH, HEIGHT = 640, 512  # of the pixel fixture

OBJECT_X, OBJECT_Y = 623422.0, 4678530.0

DETECTIONS = """
SELECT det_idx, source_patch_id, cx, cy, score, cx - hw AS xmin, cy - hh AS ymin, cx + hw AS xmax, cy + hh AS ymax FROM (
  SELECT o_orderkey AS det_idx, concat('patch_', CAST((o_orderkey * 7) % 11 AS STRING)) AS source_patch_id,
    CAST(623422.0 AS DOUBLE) + ((DIV(o_orderkey, 5) * 37) % 601) * CAST(0.5 AS DOUBLE) + ((o_orderkey % 5) * (DIV(o_orderkey, 5) % 7)) * CAST(0.125 AS DOUBLE) AS cx,
    CAST(4678530.0 AS DOUBLE) + ((DIV(o_orderkey, 5) * 53) % 997) * CAST(0.25 AS DOUBLE) + ((o_orderkey % 5) * (DIV(o_orderkey, 5) % 3)) * CAST(0.125 AS DOUBLE) + DIV(o_orderkey, 15000) * CAST(300.0 AS DOUBLE) AS cy,
    CAST(0.75 AS DOUBLE) + ((o_orderkey * 13) % 8) * CAST(0.125 AS DOUBLE) AS hw, CAST(0.75 AS DOUBLE) + ((o_orderkey * 17) % 8) * CAST(0.125 AS DOUBLE) AS hh,
    (350 + (o_orderkey * 31) % 650) / CAST(1000.0 AS DOUBLE) AS score
  FROM {orders}) b
"""

POINTS = """
SELECT event_id AS ord, ((event_id * 37) % 6010) * CAST(0.05 AS DOUBLE) AS x, ((event_id * 53) % 4985) * CAST(0.05 AS DOUBLE) AS y, value / CAST(64 AS DOUBLE) AS z FROM {events}
"""

CLOUDS = """
SELECT event_id % 40 AS stone, event_id AS ord, ((event_id * 37) % 401) * CAST(0.0078125 AS DOUBLE) AS x, ((event_id * 53) % 307) * CAST(0.0078125 AS DOUBLE) AS y, value / CAST(64 AS DOUBLE) AS z FROM {events}
"""

MEASURES = """
SELECT concat('stone_', lpad(CAST(p_partkey AS STRING), 6, '0')) AS stone_id, CAST(1.0 AS DOUBLE) + p_size / CAST(16.0 AS DOUBLE) AS equivalent_diameter_m,
  (p_partkey % 97) / CAST(8.0 AS DOUBLE) AS volume_m3, p_size / CAST(4.0 AS DOUBLE) AS area_m2, (p_partkey % 100) / CAST(100.0 AS DOUBLE) AS score FROM {part}
"""

PIXELS = f"""
SELECT px, py, v, CASE WHEN v > 0 AND v % (4 + (DIV(px, 128) + 2 * DIV(py, 128)) % 5) = 0 THEN 1 ELSE 0 END AS edge FROM (
  SELECT px, py, CASE WHEN (DIV(px, 128) + DIV(py, 128)) % 5 = 0 THEN 0 ELSE (px * 31 + py * 17 + DIV(px, 64) * DIV(py, 64) * 7) % 256 END AS v FROM (
    SELECT id % {WIDTH} AS px, DIV(id, {WIDTH}) AS py FROM (SELECT id FROM RANGE_IDS({WIDTH * HEIGHT})) r) a) b
"""

#: Octagons in local coordinates: the box of each five detections with its corners cut at a quarter.
OBJECTS = f"""
SELECT DIV(det_idx, 5) AS obj, min(xmin) - CAST({OBJECT_X} AS DOUBLE) AS x0, min(ymin) - CAST({OBJECT_Y} AS DOUBLE) AS y0, max(xmax) - CAST({OBJECT_X} AS DOUBLE) AS x1, max(ymax) - CAST({OBJECT_Y} AS DOUBLE) AS y1
FROM ({DETECTIONS}) d GROUP BY DIV(det_idx, 5)
"""

MASKS_SPARK = "SELECT vec_id, label, transform(embedding, x -> CASE WHEN x > 0 THEN 1 ELSE 0 END) AS pixels FROM {embeddings}"
MASKS_DUCK = "SELECT vec_id, label, list_transform(embedding, lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END) AS pixels FROM embeddings"


def _divisions(sql: str, infix: str) -> str:
    """Spell DIV(a, b) out, innermost first."""
    while (m := re.search(r"DIV\(([^()]*(?:\([^()]*\)[^()]*)*), (\w+)\)", sql)):
        sql = sql[: m.start()] + f"(({m[1]}) {infix} {m[2]})" + sql[m.end() :]
    return sql


def duck(sql: str) -> str:
    """For DuckDB: tables by their own names."""
    sql = re.sub(r"RANGE_IDS\((\d+)\)", r"(SELECT range AS id FROM range(\1)) q", sql)
    return _divisions(re.sub(r"\{(\w+)\}", r"\1", sql), "//")


def frame(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """For Spark: tables are Parquet scans, so that filters and columns are pushed down to them."""
    sql = re.sub(r"RANGE_IDS\((\d+)\)", r"range(\1)", sql)
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in set(re.findall(r"\{(\w+)\}", sql))}
    return spark.sql(_divisions(sql, "div"), **tables)
