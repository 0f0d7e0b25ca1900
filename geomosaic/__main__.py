"""Command line: ``python -m geomosaic fuse --detections PATH --out FOLDER [--method all]`` and so on.

A method that fails is told and doesn't keep others from running; the exit code says whether all went well.
"""

from __future__ import annotations

import argparse
import sys
import time
import traceback

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from geomosaic import session
from geomosaic.operators import fuse, points, report, stats, tiling
from geomosaic.sources import files, las, raster

#: Tilings by name: (spark, pixels, bounds, geotransform, width, height) to tiles and their summary.
TILINGS = {
    "sahi": lambda spark, px, b, gt, w, h: (t := tiling.tile_status(tiling.tile_grid(spark, w, h, gt, c := tiling.WindowConfig()), px, w, h, c), tiling.tiling_summary(t, w, h)),
    "quadtree_dom": lambda spark, px, b, gt, w, h: (t := tiling.quadtree(spark, px, b, w, h, tiling.QuadtreeConfig()), tiling.quadtree_summary(t, b)),
}


def isolated(jobs: dict) -> tuple[dict, dict]:
    """Run named jobs one after the other: results, and the errors of those that failed."""
    done, failed = {}, {}
    for name, job in jobs.items():
        try:
            begin = time.perf_counter()
            done[name] = job() | {"elapsed_seconds": round(time.perf_counter() - begin, 3)}
        except Exception as e:  # told, and the others run
            traceback.print_exc()
            failed[name] = str(e).splitlines()[0] if str(e) else type(e).__name__
    return done, failed


def slice_raster(spark: SparkSession, path: str, world: str, out: str, methods: list[str]) -> tuple[dict, dict]:
    from geomosaic.operators.vision import edge_map

    gt, shape = files.world_file(spark, world), raster.info(path)
    px = raster.pixels(raster.blocks(spark, path)).select("px", "py", F.round(F.aggregate("bands", F.lit(0.0), lambda a, v: a + v) / F.size("bands")).cast("int").alias("v"))
    px = session.written(spark, px, "gray")

    def one(m):
        edges = px.join(edge_map(spark, px, shape.width, shape.height), ["px", "py"]) if m == "quadtree_dom" else px
        tiles, summary = TILINGS[m](spark, edges, gt.bounds(shape.width, shape.height), gt, shape.width, shape.height)
        tiles = session.written(spark, tiles, "tiles")
        report.write_stage(f"{out}/{m}", summary, tiles=tiles)
        return {"tiles": tiles.count()}

    return isolated({m: lambda m=m: one(m) for m in methods})


def fuse_detections(spark: SparkSession, path: str, out: str, methods: list[str], source: str = "sahi") -> tuple[dict, dict]:
    det = files.detections(spark, path).select("det_idx", "source_patch_id", "score", *[F.get("centroid_world", F.lit(i)).alias(c) for i, c in enumerate(("cx", "cy"))], *[F.get("bbox_world", F.lit(i)).alias(c) for i, c in enumerate(("xmin", "ymin", "xmax", "ymax"))])
    det = session.written(spark, det, "detections")

    def one(m):
        found = session.written(spark, fuse.with_ids(fuse.stones(det, fuse.labels(spark, det, m), m)), "stones")
        report.write_stage(f"{out}/{source}/{m}", fuse.fusion_summary(found, source, m), stones=found)
        return {"output_stones": found.count()}

    return isolated({m: lambda m=m: one(m) for m in methods})


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="geomosaic")
    sub = parser.add_subparsers(dest="command", required=True)
    for name, inputs, known in (("slice", ("raster", "world"), list(TILINGS)), ("fuse", ("detections",), list(fuse.METHODS)), ("stats", ("stones",), []), ("points", ("cloud",), [])):
        p = sub.add_parser(name)
        for i in inputs:
            p.add_argument(f"--{i}", required=True, nargs="+" if i == "cloud" else None)
        p.add_argument("--out", required=True)
        if known:
            p.add_argument("--method", default=known[0], choices=["all", *known])
    a = parser.parse_args(argv)
    spark = spark or SparkSession.builder.getOrCreate()
    session.ship(spark)
    pick = lambda known: list(known) if a.method == "all" else [a.method]
    if a.command == "slice":
        done, failed = slice_raster(spark, a.raster, a.world, a.out, pick(TILINGS))
    elif a.command == "fuse":
        done, failed = fuse_detections(spark, a.detections, a.out, pick(fuse.METHODS))
    elif a.command == "stats":
        jobs = {n: (lambda n=n, df=df: df.write.mode("overwrite").parquet(f"{a.out}/{n}") or {}) for n, df in stats.charts(spark, spark.read.parquet(a.stones)).items()}
        done, failed = isolated(jobs)
    else:
        done, failed = isolated({"sample": lambda: points.stride_sample(las.cloud(spark, a.cloud)).write.mode("overwrite").parquet(f"{a.out}/sample") or {}})
    report.write_manifest(spark, a.out, done | {m: {"error": e} for m, e in failed.items()})
    for m, s in done.items():
        print(f"{m}: {s}")
    for m, e in failed.items():
        print(f"{m}: failed: {e}", file=sys.stderr)
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
