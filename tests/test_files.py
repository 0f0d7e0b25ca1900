"""LAS and TIFF files, configurations, stage files and the command line."""

import json
import struct
import warnings

import numpy as np
import pytest
from pyspark.sql import functions as F

from geomosaic import __main__ as cli
from geomosaic import config
from geomosaic.operators import report, spatial_join, tiling
from geomosaic.sources import las, raster


def test_las_by_ranges(spark, tmp_path):
    rng = np.random.default_rng(1)
    clouds = [np.round(rng.uniform(-500, 500, (n, 3)), 3) for n in (5000, 0, 17)]
    paths = []
    for i, c in enumerate(clouds):
        (tmp_path / f"{i}.las").write_bytes(las.encoded(c))
        paths.append(f"file://{tmp_path}/{i}.las")
    got = las.points(spark, [*paths, f"file://{tmp_path}/none.las"], range_points=700)
    for p, c in zip(paths, clouds):
        rows = got.where(F.col("file") == p).orderBy("ord").collect()
        assert [r["ord"] for r in rows] == list(range(len(c)))
        if len(c):
            assert np.allclose([(r["x"], r["y"], r["z"]) for r in rows], c, atol=6e-4)
    whole = las.cloud(spark, paths).orderBy("ord").collect()
    assert [r["ord"] for r in whole] == list(range(5017))
    assert abs(whole[5000]["x"] - clouds[2][0, 0]) < 1e-2


def test_las_headers():
    data = bytearray(las.encoded(np.ones((3, 3))))
    with pytest.raises(ValueError):
        las.header(b"LAS?" + bytes(300))
    data[104] |= 0x80
    with pytest.raises(ValueError, match="LAZ"):
        las.header(bytes(data))
    new = bytearray(las.encoded(np.ones((3, 3))).ljust(400, b"\0"))  # version 1.4 counts in eight bytes
    new[25] = 4
    struct.pack_into("<Q", new, 247, 1 << 33)
    assert las.header(bytes(new)).count == 1 << 33


@pytest.mark.parametrize("deflate", [True, False])
def test_tiff_tiles(spark, tmp_path, deflate):
    image = np.random.default_rng(2).integers(0, 255, (70, 100, 3)).astype(np.uint8)
    (tmp_path / "a.tif").write_bytes(raster.encoded(image, 32, deflate))
    path = f"file://{tmp_path}/a.tif"
    back = np.zeros_like(image)
    for r in raster.blocks(spark, path).collect():
        back[r["y"] : r["y"] + r["height"], r["x"] : r["x"] + r["width"]] = np.frombuffer(r["data"], np.uint8).reshape(r["height"], r["width"], 3)
    assert (back == image).all()
    small, scale = raster.downscaled(spark, path, 50)
    got = {(r["px"], r["py"]): r["bands"] for r in small.collect()}
    assert scale == 0.5 and len(got) == 50 * 35
    assert np.allclose(got[3, 4], image[8:10, 6:8].reshape(-1, 3).mean(0))


def test_tiff_strips(spark, tmp_path):
    image = np.arange(60, dtype=np.uint8).reshape(6, 10, 1)
    body = bytearray(b"II*\0\0\0\0\0") + image.tobytes()
    lists = len(body)
    body += struct.pack("<3I", 8, 28, 48) + struct.pack("<3I", 20, 20, 20)
    struct.pack_into("<I", body, 4, len(body))
    tags = [(256, 3, 1, 10), (257, 3, 1, 6), (258, 3, 1, 8), (259, 3, 1, 1), (273, 4, 3, lists), (277, 3, 1, 1), (278, 3, 1, 2), (279, 4, 3, lists + 12)]
    (tmp_path / "s.tif").write_bytes(bytes(body) + struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHII", *t) for t in tags) + bytes(4))
    px = raster.pixels(raster.blocks(spark, f"file://{tmp_path}/s.tif")).collect()
    assert {(r["px"], r["py"]): r["bands"][0] for r in px} == {(x, y): int(image[y, x, 0]) for y in range(6) for x in range(10)}
    (tmp_path / "bad.tif").write_bytes(b"II+\0" + bytes(20))
    with pytest.raises(ValueError):
        raster.info(f"file://{tmp_path}/bad.tif")


def test_configurations(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"_note": "x", "max_distance": 1.5, "boundary_margin_m": 3}))
    with warnings.catch_warnings(record=True) as told:
        warnings.simplefilter("always")
        got = config.load(spark, "heuristic", str(tmp_path / "c.json"))
    assert got == spatial_join.HeuristicConfig(max_distance=1.5) and "boundary_margin_m" in str(told[-1].message)
    assert config.parsed("sahi", "{}") == tiling.WindowConfig()
    with pytest.raises(ValueError):
        config.parsed("none", "{}")
    with pytest.raises(Exception):
        config.load(spark, "sahi", str(tmp_path / "absent.json"))


def test_stage_files_and_pages(spark, tmp_path):
    s = spark.createDataFrame([("sahi", 3, None)], "method string, total int, note string")
    report.write_stage(str(tmp_path / "out"), s, rows=spark.range(4))
    assert report.read_summary(spark, str(tmp_path / "out"), "method string, total int").collect()[0]["total"] == 3
    assert spark.read.parquet(str(tmp_path / "out" / "rows")).count() == 4
    page = report.as_html(s, "a < b")
    assert "a &lt; b" in page and "<td>sahi</td><td>3</td><td></td>" in page
    report.write_manifest(spark, str(tmp_path), {"b": {"n": 1}, "a": {}})
    assert spark.read.json(str(tmp_path / "manifest")).count() == 2
    text = report.compared({"one": spark.createDataFrame([(5, 0.5)], "total_tiles long, coverage_ratio double")}).head()
    assert (text["total"], text["kept"], text["coverage"]) == ("5", "?", "50.0%")


def test_one_failing_method_keeps_no_other_from_running(spark, tmp_path, monkeypatch):
    box = lambda i, patch: {"score": 0.5, "centroid_world": [i / 10, 0.0], "bbox_world": [i / 10 - 1, -1.0, i / 10 + 1, 1.0], "source_patch_id": patch}
    (tmp_path / "d.json").write_text(json.dumps([box(0, "a"), box(1, "b"), box(90, "c")]))
    args = ["fuse", "--detections", str(tmp_path / "d.json"), "--out", str(tmp_path / "out"), "--method", "all"]
    assert cli.main(args, spark) == 0
    assert spark.read.parquet(str(tmp_path / "out" / "sahi" / "heuristic" / "stones")).count() == 2

    def broken(*a):
        raise RuntimeError("no luck")

    monkeypatch.setitem(cli.fuse.METHODS, "heuristic", broken)
    assert cli.main(args, spark) == 1
    found = {r["method"]: r["stats"] for r in spark.read.json(str(tmp_path / "out" / "manifest")).collect()}
    assert "no luck" in found["heuristic"] and "output_stones" in found["correlation_clustering"]


def test_slicing_from_the_command_line(spark, tmp_path):
    image = np.random.default_rng(5).integers(0, 255, (64, 80, 3)).astype(np.uint8)
    (tmp_path / "a.tif").write_bytes(raster.encoded(image, 32))
    (tmp_path / "a.tfw").write_text("0.5\n0\n0\n-0.5\n100\n200\n")
    args = ["slice", "--raster", f"file://{tmp_path}/a.tif", "--world", str(tmp_path / "a.tfw"), "--out", str(tmp_path / "out"), "--method", "all"]
    assert cli.main(args, spark) == 0
    assert spark.read.parquet(str(tmp_path / "out" / "sahi" / "tiles")).count() == 1
    assert spark.read.parquet(str(tmp_path / "out" / "quadtree_dom" / "tiles")).count() >= 4
