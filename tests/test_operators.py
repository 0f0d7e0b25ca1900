"""Operators beside plain loops, and what must hold whatever the data."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from geomosaic.functions import geo, rle
from geomosaic.operators import fuse, graph, points, spatial_join, stats, tiling, vision, volume


def detections(n, seed=5):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        cx, cy, hw, hh = (r.randrange(0, 160) / 8, r.randrange(0, 160) / 8, r.randrange(6, 14) / 8, r.randrange(6, 14) / 8)
        rows.append((i, f"patch_{r.randrange(4)}", cx, cy, r.randrange(35, 100) / 100, cx - hw, cy - hh, cx + hw, cy + hh))
    return rows


SCHEMA = "det_idx long, source_patch_id string, cx double, cy double, score double, xmin double, ymin double, xmax double, ymax double"


def box_iou(a, b):
    w, h = min(a[7], b[7]) - max(a[5], b[5]), min(a[8], b[8]) - max(a[6], b[6])
    if w <= 0 or h <= 0:
        return 0.0
    both = w * h
    return both / ((a[7] - a[5]) * (a[8] - a[6]) + (b[7] - b[5]) * (b[8] - b[6]) - both)


def touching(a, b):
    return a[5] <= b[7] and b[5] <= a[7] and a[6] <= b[8] and b[6] <= a[8]


def groups_of(n, edges):
    label = list(range(n))
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            m = min(label[a], label[b])
            if label[a] != m or label[b] != m:
                label[a] = label[b] = m
                changed = True
    return label


def test_heuristic_groups_equal_a_pair_loop(spark):
    rows = detections(250)
    cfg = spatial_join.HeuristicConfig()
    want = [(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[1] != b[1] and math.dist(a[2:4], b[2:4]) <= 0.8 and touching(a, b) and box_iou(a, b) >= 0.3]
    det = spark.createDataFrame(rows, SCHEMA)
    assert sorted((r["src"], r["dst"]) for r in spatial_join.heuristic_edges(det, cfg).collect()) == sorted(want)
    found = {r["det_idx"]: r["label"] for r in fuse.heuristic_labels(spark, det, cfg).collect()}
    assert [found[i] for i in range(len(rows))] == groups_of(len(rows), want)


def test_pivot_clusters_equal_the_sequential_rule(spark):
    rows = detections(250, seed=9)
    det = spark.createDataFrame(rows, SCHEMA)
    cfg = spatial_join.CorrelationConfig()
    edges = [(r["src"], r["dst"]) for r in spatial_join.affinity_edges(det, cfg).collect()]
    near = {i: set() for i in range(len(rows))}
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    left, want = set(near), {}
    while left:
        pivot = min(left)
        for i in {pivot, *(near[pivot] & left)}:
            want[i] = pivot
            left.discard(i)
    assert {r["det_idx"]: r["label"] for r in fuse.correlation_labels(spark, det, cfg).collect()} == want


def test_every_detection_is_in_one_object(spark):
    det = spark.createDataFrame(detections(120), SCHEMA)
    found = fuse.stones(det, fuse.labels(spark, det, "heuristic"), "heuristic").collect()
    assert sorted(i for s in found for i in s["detection_indices"]) == list(range(120))
    with pytest.raises(Exception):
        fuse.labels(spark, det, "no such method")


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(200)]
    star = [(1000, 1000 + i) for i in range(1, 60)]
    found = {r["node"]: r["component"] for r in graph.connected_components(spark, spark.createDataFrame(chain + star, "src long, dst long")).collect()}
    assert {found[i] for i in range(201)} == {0} and {found[i] for i in range(1000, 1060)} == {1000}
    assert graph.connected_components(spark, spark.createDataFrame([], "src long, dst long")).count() == 0


def test_run_lengths_round_trip_and_the_older_form_inverts(spark):
    masks = [[0, 0, 1, 1], [1, 1, 0, 1], [1, 1, 1, 1], [0, 0, 0, 0]]
    df = spark.createDataFrame([(i, m) for i, m in enumerate(masks)], "i int, pixels array<int>")
    two = F.lit(2)
    got = df.select("i", rle.decode(rle.encode(F.col("pixels"), two, two), 1).alias("p"), rle.decode(rle.encode(F.col("pixels"), two, two, legacy=True), 1).alias("old")).orderBy("i").collect()
    assert [r["p"] for r in got] == masks
    assert got[1]["old"] == [0, 0, 1, 0] and got[0]["old"] == masks[0]


def test_affinity_decay(spark):
    row = spark.range(1).select(*[geo.affinity(F.lit(d), F.lit(0.0), F.lit(False), 0.7, 0.3, 1.2).alias(f"d{i}") for i, d in enumerate((0.5, 0.8, 1.0))]).head()
    assert [round(v, 2) for v in row] == [0.77, 0.52, 0.36]


def test_window_positions(spark):
    cfg = tiling.WindowConfig()
    row = spark.range(1).select(tiling.window_positions(7270, cfg).alias("x"), tiling.window_positions(500, cfg).alias("small")).head()
    assert row["small"] == [0] and row["x"][0] == 0 and row["x"][-1] == 7270 - 1024 and len(row["x"]) == 10


def test_hull_of_a_cube(spark):
    cube = np.array([(x, y, z) for x in (0, 1) for y in (0, 1) for z in (0, 1)] + [(0.5, 0.5, 0.5)], float)
    v, a, _ = volume.hull(cube)
    assert abs(v - 1) < 1e-9 and abs(a - 6) < 1e-9
    assert volume.hull(cube[:4] * [1, 1, 0])[0] == 0


def test_flat_and_small_clouds_have_no_volume(spark):
    pts = spark.createDataFrame([("flat", i, float(i % 3), float(i // 3), 1.0) for i in range(9)] + [("few", i, 0.0, 0.0, float(i)) for i in range(3)], "stone string, ord long, x double, y double, z double")
    got = {r["stone"]: r["volume_m3"] for r in volume.compute_volume(pts, ["stone"]).collect()}
    assert got == {"flat": 0.0, "few": 0.0}
    with pytest.raises(ValueError):
        volume.compute_volume(pts, ["stone"], method="none")


def test_outline_of_a_square():
    mask = np.zeros((12, 12), int)
    mask[2:10, 3:11] = 1
    p = vision.polygon_of(mask)
    assert abs(abs(vision.shoelace(p)) - 49) < 1e-6
    assert vision.polygon_of(np.zeros((4, 4), int)) is None


def test_mask_polygons_keep_rows_and_columns(spark):
    rows = [(1, ([6, 6], [7, 4, 2, 4, 2, 4, 2, 4, 7]), [10, 20]), (2, ([2, 2], [4]), [0, 0]), (3, None, None)]
    masks = spark.createDataFrame(rows, "id int, rle_mask struct<size:array<int>,counts:array<int>>, pixel_origin array<int>")
    got = {r["id"]: r["polygon"] for r in vision.mask_polygons(masks, geo.Geotransform(0.0, 1.0, 0.0, 0.0, 0.0, -1.0)).collect()}
    assert sorted((p["x"], p["y"]) for p in got[1]) == [(11.0, -24.0), (11.0, -21.0), (14.0, -24.0), (14.0, -21.0)]
    assert got[2] is None and got[3] is None


def test_points_on_a_boundary_are_inside_and_the_first_object_wins(spark):
    square = lambda x, s: [{"x": x, "y": 0.0}, {"x": x + s, "y": 0.0}, {"x": x + s, "y": s}, {"x": x, "y": s}]
    polys = spark.createDataFrame([(0, square(0.0, 4.0)), (1, square(2.0, 4.0))], "si int, polygon array<struct<x:float,y:float>>")
    pts = spark.createDataFrame([(0, 3.0, 1.0), (1, 5.0, 1.0), (2, 6.0, 4.0), (3, 7.0, 1.0)], "ord long, x float, y float")
    got = {r["ord"]: r["si"] for r in spatial_join.points_in_objects(pts, polys).collect()}
    assert got == {0: 0, 1: 1, 2: 1}
    shuffled = {r["ord"]: r["si"] for r in spatial_join.points_in_objects(pts, polys, broadcast_bytes=-1).collect()}
    assert shuffled == got


def test_colouring_does_not_shuffle_the_points(spark):
    square = spark.createDataFrame([(0, [{"x": 0.0, "y": 0.0}, {"x": 4.0, "y": 0.0}, {"x": 4.0, "y": 4.0}])], "si int, polygon array<struct<x:float,y:float>>")
    pts = spark.range(50).select(F.col("id").alias("ord"), (F.col("id") / 10).alias("x"), (F.col("id") / 10).alias("y"), F.lit(0.0).alias("z"))
    df = points.colored(pts, square)
    plan = df._jdf.queryExecution().sparkPlan().toString()
    above = plan[: plan.index("BroadcastHashJoin")]
    assert "Exchange" not in above and "SortMergeJoin" not in plan and df.count() == 50


def test_boxes_touch_pads_both(spark):
    row = spark.range(1).select(*[geo.boxes_touch(geo.Box(*map(F.lit, (0.0, 0.0, 1.0, 1.0))), geo.Box(*map(F.lit, (x, 0.0, x + 1, 1.0))), 0.5).alias(f"b{i}") for i, x in enumerate((1.5, 2.0, 2.25))]).head()
    assert list(row) == [True, True, False]


def test_statistics_of_no_rows(spark):
    none = spark.createDataFrame([], "stone_id string, equivalent_diameter_m double, volume_m3 double, area_m2 double, score double")
    assert stats.describe(stats.measures(none)).count() == 1
    assert [r["n"] for r in stats.size_buckets(spark, stats.measures(none)).collect()] == [0, 0, 0, 0]


def test_stride_sample_keeps_every_kth(spark):
    pts = spark.range(100).select(F.col("id").alias("ord"))
    assert [r["ord"] for r in points.stride_sample(pts, 10).orderBy("ord").collect()] == list(range(0, 100, 10))


def sequential_pivots(n, edges):
    near = {i: set() for i in range(n)}
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    left, out = set(near), {}
    for pivot in range(n):
        if pivot in left:
            for i in {pivot, *(near[pivot] & left)}:
                out[i] = pivot
                left.discard(i)
    return out


def test_pivots_of_long_chains(spark):
    n = 1000
    edges = spark.createDataFrame([(i, i + 1) for i in range(n - 1)], "src long, dst long")
    nodes = spark.range(n).select(F.col("id").alias("node"))
    want = sequential_pivots(n, [(i, i + 1) for i in range(n - 1)])
    assert {r["node"]: r["pivot"] for r in graph.pivot_clusters(spark, nodes, edges).collect()} == want


@pytest.mark.parametrize("task_edges", [0, 6, 40])
def test_rounds_over_large_components_and_walks_over_small_ones_agree(spark, task_edges):
    r = random.Random(task_edges)
    pairs = [(r.randrange(40), r.randrange(40)) for _ in range(70)] + [(50 + i, 51 + i) for i in range(12)] + [(70, 71), (71, 72), (70, 70)]
    edges = spark.createDataFrame(pairs, "src long, dst long")
    nodes = spark.range(80).select(F.col("id").alias("node"))
    got = {r["node"]: r["pivot"] for r in graph.pivot_clusters(spark, nodes, edges, task_edges).collect()}
    assert got == sequential_pivots(80, [p for p in pairs if p[0] != p[1]])


def test_components_by_rounds_equal_those_of_one_task(spark, monkeypatch):
    monkeypatch.setattr(graph, "CHUNK_EDGES", 16)
    r = random.Random(3)
    pairs = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(400 + i, 401 + i) for i in range(90)] + [(None, 3), (7, 7)]
    edges = spark.createDataFrame(pairs, "src long, dst long").repartition(4)
    by_rounds, at_once = ({r["node"]: r["component"] for r in graph.connected_components(spark, edges, n).collect()} for n in (0, 10_000))
    assert by_rounds == at_once
    want = groups_of(500, [p for p in pairs if p[0] is not None])
    assert by_rounds == {i: want[i] for p in pairs if p[0] is not None and p[0] != p[1] for i in p}


def test_a_shared_folder_is_asked_for_on_a_cluster(spark, monkeypatch):
    from geomosaic import session

    class Context:
        master = "spark://host:7077"
        _conf = {}

        class _jsc:
            @staticmethod
            def sc():
                return type("S", (), {"getCheckpointDir": staticmethod(lambda: type("O", (), {"isDefined": staticmethod(lambda: False)}))})

    class Session:
        conf = {}
        sparkContext = Context

    with pytest.raises(RuntimeError):
        session.shared_dir(Session)
    kept = session.written(spark, spark.range(3), "kept")
    session.discard(spark, kept)
    with pytest.raises(Exception):
        spark.read.parquet(kept.written_to)


def test_running_volume_is_the_same_for_any_order_of_repeated_keys(spark):
    rows = [("stone_100000", 2.0, float(v)) for v in (5, 1, 3)] + [("stone_100001", 2.0, 2.0), ("stone_000001", 3.0, 4.0)]
    for given in (rows, rows[::-1]):
        df = spark.createDataFrame(given, "stone_id string, equivalent_diameter_m double, volume_m3 double").coalesce(1)
        got = sorted((r["rank"], r["stone_id"], r["volume_m3"], r["running"]) for r in stats.cumulative_volume(df).collect())
        assert got == [(1, "stone_000001", 4.0, 4.0), (2, "stone_100000", 1.0, 5.0), (3, "stone_100000", 3.0, 8.0), (4, "stone_100000", 5.0, 13.0), (5, "stone_100001", 2.0, 15.0)]
