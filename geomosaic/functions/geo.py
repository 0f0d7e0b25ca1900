"""Column functions over geometry: affine maps, boxes, distances, affinities, labels.

All stay in whole-stage codegen. Boxes are four flat columns (xmin, ymin, xmax, ymax), so filters on them push down.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Geotransform:
    """x = origin_x + px * pixel_w + py * rot_x; y = origin_y + px * rot_y + py * pixel_h."""

    origin_x: float
    pixel_w: float
    rot_x: float
    origin_y: float
    rot_y: float
    pixel_h: float

    @property
    def resolution(self) -> float:
        return abs(self.pixel_w)

    def bounds(self, width: int, height: int) -> tuple[float, float, float, float]:
        xs = [self.origin_x, self.origin_x + width * self.pixel_w + height * self.rot_x]
        ys = [self.origin_y, self.origin_y + width * self.rot_y + height * self.pixel_h]
        return min(xs), min(ys), max(xs), max(ys)


@dataclass(frozen=True)
class Box:
    xmin: Column
    ymin: Column
    xmax: Column
    ymax: Column

    @staticmethod
    def of(prefix: str = "") -> Box:
        return Box(*(F.col(f"{prefix}{c}") for c in ("xmin", "ymin", "xmax", "ymax")))

    @property
    def area(self) -> Column:
        return (self.xmax - self.xmin) * (self.ymax - self.ymin)

    @property
    def center(self) -> tuple[Column, Column]:
        return (self.xmin + self.xmax) / 2, (self.ymin + self.ymax) / 2


def _d(x) -> Column:
    return x.cast("double") if isinstance(x, Column) else F.lit(float(x))


def pixel_to_world(gt: Geotransform, px: Column, py: Column) -> tuple[Column, Column]:
    px, py = _d(px), _d(py)
    return (
        F.lit(gt.origin_x) + px * F.lit(gt.pixel_w) + py * F.lit(gt.rot_x),
        F.lit(gt.origin_y) + px * F.lit(gt.rot_y) + py * F.lit(gt.pixel_h),
    )


def _held(x: Column, top: int) -> Column:
    """Truncated toward zero and held to 0..top."""
    return F.greatest(F.lit(0).cast("long"), F.least(x.cast("long"), F.lit(top).cast("long")))


def world_to_pixel(bounds: tuple[float, float, float, float], width: int, height: int, x: Column, y: Column) -> tuple[Column, Column]:
    """Proportional position within the bounds; y grows downwards. The result is a valid index, so at most size - 1."""
    x0, y0, x1, y1 = bounds
    return (
        _held((_d(x) - F.lit(x0)) / F.lit(x1 - x0) * F.lit(float(width)), width - 1),
        _held((F.lit(y1) - _d(y)) / F.lit(y1 - y0) * F.lit(float(height)), height - 1),
    )


def crop_window(bounds: tuple[float, float, float, float], width: int, height: int, box: Box) -> Box:
    """The half-open pixel window of a world box, held to 0..size, ends in order. May be empty."""
    x0, y0, x1, y1 = bounds
    px = [_held((c - F.lit(x0)) / F.lit(x1 - x0) * F.lit(float(width)), width) for c in (box.xmin, box.xmax)]
    py = [_held((F.lit(y1) - c) / F.lit(y1 - y0) * F.lit(float(height)), height) for c in (box.ymin, box.ymax)]
    return Box(F.least(*px), F.least(*py), F.greatest(*px), F.greatest(*py))


def scaled_pixel_box(gt: Geotransform, scale: float, box: Box) -> Box:
    """A world box on an image scaled by ``scale``; rotation terms don't take part."""
    px = [((c - F.lit(gt.origin_x)) / F.lit(gt.pixel_w) * F.lit(float(scale))).cast("long") for c in (box.xmin, box.xmax)]
    py = [((c - F.lit(gt.origin_y)) / F.lit(gt.pixel_h) * F.lit(float(scale))).cast("long") for c in (box.ymin, box.ymax)]
    return Box(F.least(*px), F.least(*py), F.greatest(*px), F.greatest(*py))


def expand_bounds(box: Box, overlap: float, limits: tuple[float, float, float, float]) -> Box:
    """Half the overlap on each side, clipped to the limits."""
    half = F.lit(overlap / 2)
    x0, y0, x1, y1 = map(F.lit, limits)
    return Box(F.greatest(x0, box.xmin - half), F.greatest(y0, box.ymin - half), F.least(x1, box.xmax + half), F.least(y1, box.ymax + half))


def equivalent_diameter(area: Column) -> Column:
    return F.sqrt(F.lit(4.0) * area / F.pi())


def distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    dx, dy = ax - bx, ay - by
    return F.sqrt(dx * dx + dy * dy)


def boxes_touch(a: Box, b: Box, pad: float = 0.0) -> Column:
    """Closed boxes, both padded on each side."""
    p = F.lit(2 * float(pad))
    return (a.xmin - p <= b.xmax) & (b.xmin <= a.xmax + p) & (a.ymin - p <= b.ymax) & (b.ymin <= a.ymax + p)


def iou(a: Box, b: Box) -> Column:
    """Intersection over union; 0 where they share no area (also for two boxes without area)."""
    w = F.least(a.xmax, b.xmax) - F.greatest(a.xmin, b.xmin)
    h = F.least(a.ymax, b.ymax) - F.greatest(a.ymin, b.ymin)
    inter = w * h
    return F.when((w > 0) & (h > 0), F.try_divide(inter, a.area + b.area - inter)).otherwise(F.lit(0.0))


def affinity(dist: Column, overlap: Column, same_tile: Column, sigma: float, iou_weight: float, boost: float) -> Column:
    """A Gaussian of the distance, raised by the overlap and, within one tile, by a boost above 1."""
    base = F.exp(-(dist * dist) / F.lit(2.0 * sigma * sigma)) * (F.lit(1.0) + F.lit(iou_weight) * overlap)
    return F.when(same_tile, base * F.lit(boost)).otherwise(base) if boost > 1.0 else base


def affinity_radius(max_distance: float, sigma: float, iou_weight: float, boost: float, threshold: float) -> float:
    """No pair farther apart reaches the threshold: overlap is at most 1, so the Gaussian alone must carry the rest."""
    best = (1.0 + max(iou_weight, 0.0)) * max(boost, 1.0)
    if threshold <= 0:
        return max_distance
    ratio = best / threshold
    return min(max_distance, sigma * math.sqrt(2.0 * math.log(ratio)) + 1e-9) if ratio > 1 else min(max_distance, 1e-9)


def quadtree_level(tile_id: Column) -> Column:
    """Underscores less 1: a base tile is level 1."""
    return (F.length(tile_id) - F.length(F.replace(tile_id, F.lit("_"), F.lit(""))) - 1).cast("int")


#: Colours (red, green, blue in 0..255) for clusters of up to 1, 2, 3, 5, 10 and more members.
CLUSTER_COLORS = ((46, 204, 113), (52, 152, 219), (155, 89, 182), (241, 196, 15), (230, 126, 34), (231, 76, 60))
CLUSTER_LIMITS = (1, 2, 3, 5, 10)


def cluster_class(size: Column) -> Column:
    """0..5 by the limits above."""
    out = F.lit(len(CLUSTER_LIMITS))
    for i, top in reversed(list(enumerate(CLUSTER_LIMITS))):
        out = F.when(size <= top, i).otherwise(out)
    return out


def cluster_color(size: Column) -> Column:
    """array<int> of red, green, blue."""
    return F.get(F.array(*[F.array(*map(F.lit, c)) for c in CLUSTER_COLORS]), cluster_class(size))


#: The twelve colours that objects take in turn (red, green, blue in 0..1).
PALETTE = (
    (1.0, 0.0, 0.0),
    (0.0, 0.6, 0.0),
    (0.0, 0.0, 1.0),
    (1.0, 0.7, 0.0),
    (0.6, 0.0, 1.0),
    (0.0, 0.8, 0.8),
    (1.0, 0.0, 0.6),
    (0.6, 0.4, 0.0),
    (0.0, 0.5, 0.3),
    (0.8, 0.2, 0.2),
    (0.3, 0.3, 0.7),
    (0.7, 0.5, 0.3),
)
GRAY = 0.6


def palette_color(index: Column) -> Column:
    """array<double> of red, green, blue; gray for null."""
    table = F.array(*[F.array(*[F.lit(c) for c in rgb]) for rgb in PALETTE])
    return F.when(index.isNull(), F.array(F.lit(GRAY), F.lit(GRAY), F.lit(GRAY))).otherwise(F.get(table, F.pmod(index, F.lit(len(PALETTE))).cast("int")))


GOLDEN = 0.618033988749895


def golden_hue(index: Column) -> Column:
    return (index.cast("double") * F.lit(GOLDEN)) % F.lit(1.0)


def hsv_to_rgb(h: Column, s: float, v: float) -> tuple[Column, Column, Column]:
    sector = F.floor(h * 6.0).cast("int")
    f = h * F.lit(6.0) - sector.cast("double")
    p, q, t = F.lit(v * (1 - s)), F.lit(v) * (F.lit(1.0) - F.lit(s) * f), F.lit(v) * (F.lit(1.0) - F.lit(s) * (F.lit(1.0) - f))
    top, k = F.lit(v), F.pmod(sector, F.lit(6))
    pick = lambda *c: F.when(k == 0, c[0]).when(k == 1, c[1]).when(k == 2, c[2]).when(k == 3, c[3]).when(k == 4, c[4]).otherwise(c[5])
    return pick(top, q, p, p, t, top), pick(t, top, top, q, p, p), pick(p, p, t, top, top, q)


def normalised(z: Column, low: Column, high: Column) -> Column:
    return (z - low) / (high - low + F.lit(1e-8))


def gray_mean(*channels: Column) -> Column:
    """The plain mean, as fixed-size tiles use it."""
    return sum(channels[1:], channels[0]).cast("double") / F.lit(float(len(channels)))


def gray_luma(blue: Column, green: Column, red: Column) -> Column:
    """The weighted mean in whole numbers, as adaptive tiles use it."""
    return F.round(F.lit(0.114) * blue + F.lit(0.587) * green + F.lit(0.299) * red).cast("int")


def numbered(prefix: str, n: Column) -> Column:
    return F.format_string(f"{prefix}_%06d", n)


def short_label(s: Column) -> Column:
    return F.right(s, F.lit(4))


def basename(path: Column) -> Column:
    return F.element_at(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), -1)


def intensity(value: Column, top: Column) -> Column:
    """0..255 by share of the top; a top of 0 counts as 1."""
    return (F.lit(255.0) * value / F.when(top > 0, top).otherwise(F.lit(1.0))).cast("int")


def scaled_point(gt: Geotransform, scale: float, x: Column, y: Column) -> tuple[Column, Column]:
    """A world point on an image scaled by ``scale``, truncated to whole pixels."""
    return ((x - F.lit(gt.origin_x)) / F.lit(gt.pixel_w) * F.lit(float(scale))).cast("long"), ((y - F.lit(gt.origin_y)) / F.lit(gt.pixel_h) * F.lit(float(scale))).cast("long")


def drawable(box: Box, least: int = 2) -> Column:
    """Whether a pixel box has ``least`` pixels at least on each side."""
    return (box.xmax - box.xmin >= least) & (box.ymax - box.ymin >= least)


def blend(a: Column, b: Column, alpha: float) -> Column:
    """alpha of ``a`` and the rest of ``b``, as a byte: rounded half to even and held to 0..255."""
    return F.greatest(F.lit(0), F.least(F.lit(255), F.bround(F.lit(alpha) * a + F.lit(1.0 - alpha) * b))).cast("int")


def three_channels(bands: Column) -> Column:
    """array<int> of three bands: one is repeated, a fourth is dropped; values beyond a byte are held to it."""
    byte = lambda v: F.greatest(F.lit(0), F.least(F.lit(255), v.cast("int")))
    held = F.transform(bands, byte)
    return F.when(F.size(bands) == 1, F.array_repeat(F.get(held, F.lit(0)), 3)).when(F.size(bands) >= 3, F.slice(held, 1, 3))


def percent(share: Column, digits: int = 1) -> Column:
    """0.5 as "50.0%"."""
    return F.concat(F.format_number(share * 100, digits), F.lit("%"))
