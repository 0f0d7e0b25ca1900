"""Run-length masks: struct<size: array<int>, counts: array<int>> over row-major pixels.

Canonical form: the first run is background, of length 0 if the first pixel is foreground. ``legacy`` leaves that run out, as
older files do; decoded canonically, such a mask comes back inverted if its first pixel is foreground.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _let(value: Column, body) -> Column:
    """body(value), with the value computed once: as a lambda's variable it isn't computed again for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def encode(pixels: Column, height: Column, width: Column, legacy: bool = False) -> Column:
    """pixels: array<int>, 0 or not. No UDF: run starts are found by comparing neighbours."""

    def counts(on: Column) -> Column:
        n = F.size(on)
        starts = F.filter(F.sequence(F.lit(1), n), lambda i: (i == 1) | (F.get(on, i - 1) != F.get(on, i - 2)))
        runs = _let(starts, lambda st: F.zip_with(st, F.concat(F.slice(st, 2, F.size(st)), F.array(n + 1)), lambda a, b: (b - a).cast("int")))
        if not legacy:
            runs = F.when(F.get(on, F.lit(0)) == 1, F.concat(F.array(F.lit(0)), runs)).otherwise(runs)
        return F.when(n > 0, runs).otherwise(F.array().cast("array<int>"))

    on = F.transform(pixels, lambda v: F.when(v != 0, 1).otherwise(0))
    return F.struct(F.array(height.cast("int"), width.cast("int")).alias("size"), _let(on, counts).alias("counts"))


def decode(rle: Column, on: int = 255) -> Column:
    """Row-major pixels; runs in odd places (from 0) are foreground."""
    return F.flatten(F.transform(rle["counts"], lambda c, i: F.array_repeat(F.when(i % 2 == 1, F.lit(on)).otherwise(F.lit(0)), c)))


def area(rle: Column) -> Column:
    """Foreground pixels, without decoding."""
    return F.aggregate(F.transform(rle["counts"], lambda c, i: F.when(i % 2 == 1, c).otherwise(F.lit(0)).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)


def contains(rle: Column, px: Column, py: Column) -> Column:
    """Whether a pixel is foreground: the number of run ends up to it is odd."""
    at = py.cast("long") * rle["size"][1] + px.cast("long")
    state = F.aggregate(
        rle["counts"],
        F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).alias("passed")),
        lambda a, c: F.struct((a["end"] + c).alias("end"), (a["passed"] + F.when(a["end"] + c <= at, 1).otherwise(0)).alias("passed")),
    )
    inside = (px >= 0) & (py >= 0) & (px < rle["size"][1]) & (py < rle["size"][0])
    return inside & (state["passed"] % 2 == 1)


def features(rle: Column) -> Column:
    """struct<area, cx, cy, xmin, ymin, xmax, ymax>: pixel count, centroid truncated to whole pixels, and the box with its far
    edges exclusive. Null for an empty mask."""
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x)

    def measured(p: Column) -> Column:
        xs, ys, n = p["xs"], p["ys"], F.size(p["xs"])
        return F.when(n > 0, F.struct(
            n.cast("long").alias("area"), F.try_divide(total(xs), n).cast("int").alias("cx"), F.try_divide(total(ys), n).cast("int").alias("cy"),
            F.array_min(xs).alias("xmin"), F.array_min(ys).alias("ymin"), (F.array_max(xs) + 1).alias("xmax"), (F.array_max(ys) + 1).alias("ymax"),
        ))

    width = rle["size"][1]
    places = lambda pixels: F.filter(F.transform(pixels, lambda v, i: F.when(v == 1, i)), lambda i: i.isNotNull())
    split = lambda on: F.struct(F.transform(on, lambda i: i % width).alias("xs"), F.transform(on, lambda i: F.floor(i / width).cast("int")).alias("ys"))
    return _let(_let(_let(decode(rle, 1), places), split), measured)


def resize_nearest(pixels: Column, height: int, width: int, to_height: int, to_width: int) -> Column:
    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(to_height - 1)), lambda r: F.transform(F.sequence(F.lit(0), F.lit(to_width - 1)), lambda c: F.get(pixels, (F.floor(r * F.lit(height) / F.lit(to_height)) * width + F.floor(c * F.lit(width) / F.lit(to_width))).cast("int")))))
