import json

import numpy as np
import pytest

from geomosaic.sources import files


def test_world_file(spark, tmp_path):
    p = tmp_path / "a.tfw"
    p.write_text("0.01\n0\n\n0\n-0.01\n623422.47\n4678756.5\n")
    gt = files.world_file(spark, str(p))
    assert (gt.origin_x, gt.pixel_w, gt.rot_x, gt.origin_y, gt.rot_y, gt.pixel_h) == (623422.47, 0.01, 0.0, 4678756.5, 0.0, -0.01)
    p.write_text("1\n2\n")
    with pytest.raises(ValueError):
        files.world_file(spark, str(p))


def test_stage_records(spark, tmp_path):
    (tmp_path / "t.json").write_text(json.dumps({"patches": [{"patch_id": "patch_000000", "pixel_origin": [0, 0]}, {"patch_id": "patch_000001", "status": "skipped_black"}]}, indent=2))
    assert [(r["ord"], r["status"]) for r in files.patches(spark, str(tmp_path / "t.json")).collect()] == [(0, "kept"), (1, "skipped_black")]
    (tmp_path / "q.json").write_text(json.dumps({"tiles": [{"tile_id": "tile_0_0", "bounds_m": [0, 0, 1, 1]}]}))
    assert files.quadtree_tiles(spark, str(tmp_path / "q.json")).head()["skipped"] is False
    (tmp_path / "d.json").write_text(json.dumps([{"score": 0.5, "rle_mask": {"size": [1, 2], "counts": [1, 1]}}, {"score": 0.7, "source_patch_id": "p"}], indent=2))
    rows = files.detections(spark, str(tmp_path / "d.json")).orderBy("det_idx").collect()
    assert [(r["det_idx"], r["score"], r["source_patch_id"]) for r in rows] == [(0, 0.5, ""), (1, 0.7, "p")]
    assert rows[0]["rle_mask"]["counts"] == [1, 1]
    (tmp_path / "s.json").write_text(json.dumps({"stones": [{"stone_id": "stone_000000", "detection_indices": [0, 1]}]}))
    assert files.stones(spark, str(tmp_path / "s.json")).head()["detection_indices"] == [0, 1]
    (tmp_path / "m.json").write_text(json.dumps({"a": {"total_tiles": 3}, "b": {}}))
    assert {r["method"] for r in files.manifest(spark, str(tmp_path / "m.json")).collect()} == {"a", "b"}


def test_ply_points(spark, tmp_path):
    head = "ply\nformat {}\nelement vertex 2\nproperty float x\nproperty float y\nproperty float z\nproperty uchar red\nend_header\n"
    (tmp_path / "a.ply").write_text(head.format("ascii 1.0") + "0 1 2 7\n3 4 5 7\n")
    v = np.array([(0, 1, 2, 7), (3, 4, 5, 7)], [("x", "<f4"), ("y", "<f4"), ("z", "<f4"), ("red", "u1")])
    (tmp_path / "b.ply").write_bytes(head.format("binary_little_endian 1.0").encode() + v.tobytes())
    rows = files.ply_points(spark, str(tmp_path / "*.ply")).collect()
    assert sorted((r["file"][-5:], r["ord"], r["x"], r["z"]) for r in rows) == [("a.ply", 0, 0.0, 2.0), ("a.ply", 1, 3.0, 5.0), ("b.ply", 0, 0.0, 2.0), ("b.ply", 1, 3.0, 5.0)]
