"""Image slices as arrays: order, windows, boxes, midlines, crops, air scores, and volumes of series.

A slice is a row with ``pixels`` (row-major array), ``h`` and ``w``. Expressions work on arrays; steps that
walk neighbours or resample run in NumPy over Arrow batches; a series, some hundred slices, is one group.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.functions.scalar import even_index, file_number
from quernstone.operators.ordered import block_around

BONE, AIR = 300.0, -500.0


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def slice_order(z: Column, instance: Column, path: Column) -> Column:
    """A key that sorts a series: by z, then by instance number, then by the number in the file name.

    Slices with a better source come first; equal z are ordered by instance number.
    """
    n = F.coalesce(instance.cast("long"), F.lit(0).cast("long"))
    rank = F.when(z.isNotNull(), 0).when(instance.isNotNull(), 1).otherwise(2)
    key = F.when(z.isNotNull(), z.cast("double")).when(instance.isNotNull(), instance.cast("double")).otherwise(file_number(path).cast("double"))
    return F.struct(rank.alias("rank"), key.alias("key"), F.when(z.isNotNull(), n).otherwise(F.lit(0).cast("long")).alias("tie"))


def bounding_box(pixels: Column, w: Column, above: float = BONE, x_from: Column | None = None, x_to: Column | None = None) -> Column:
    """struct (y0, y1, x0, x1) of the pixels over ``above``, of columns x_from to x_to if given; null without any."""
    x = lambda i: i % w

    def inside(v, i):
        ok = v > above
        ok = ok if x_from is None else ok & (x(i) >= x_from)
        return ok if x_to is None else ok & (x(i) <= x_to)

    places = F.array_compact(F.transform(pixels, lambda v, i: F.when(inside(v, i), i)))
    rows = lambda p: F.transform(p, lambda i: F.floor(i / w).cast("int"))
    cols = lambda p: F.transform(p, lambda i: x(i).cast("int"))
    box = lambda p: F.struct(F.array_min(rows(p)).alias("y0"), F.array_max(rows(p)).alias("y1"), F.array_min(cols(p)).alias("x0"), F.array_max(cols(p)).alias("x1"))
    return _let(places, lambda p: F.when(F.size(p) > 0, box(p)))


def mean_column(pixels: Column, w: Column, above: float = BONE) -> Column:
    """Mean x of the pixels over ``above``; null without any."""
    xs = F.array_compact(F.transform(pixels, lambda v, i: F.when(v > above, (i % w).cast("double"))))
    return _let(xs, lambda a: F.when(F.size(a) > 0, F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a)))


def midlines(slices: DataFrame, series: str) -> DataFrame:
    """(series, mid_x): the rounded median of its slices' mean bone columns; null without bone."""
    return slices.groupBy(series).agg(F.bround(F.median(mean_column(F.col("pixels"), F.col("w")))).cast("int").alias("mid_x"))


def split_sides(pixels: Column, h: Column, w: Column, mid: Column, mirror: bool = True) -> tuple[Column, Column, Column]:
    """Left pixels, right pixels (mirrored) and the left width; a null middle is half of the width."""
    m = F.greatest(F.lit(1), F.least(w - 1, F.coalesce(mid, F.floor(w / 2)))).cast("int")
    rows = F.sequence(F.lit(0), h - 1)
    right = lambda r: F.slice(pixels, r * w + m + 1, w - m)
    return F.flatten(F.transform(rows, lambda r: F.slice(pixels, r * w + 1, m))), F.flatten(F.transform(rows, lambda r: F.reverse(right(r)) if mirror else right(r))), m


def crop_centre(box: Column, h: Column, w: Column, bias: float = 0.25) -> Column:
    """struct (y, x): the middle of a box's rows, and ``bias`` of its width from its left edge; without a box the middle."""
    y = F.bround((box["y0"] + box["y1"]) / 2.0)
    x = F.bround(box["x0"] + F.lit(bias) * F.greatest(F.lit(1), box["x1"] - box["x0"]))
    return F.struct(F.coalesce(y, F.floor(h / 2)).cast("int").alias("y"), F.coalesce(x, F.floor(w / 2)).cast("int").alias("x"))


def stack_centres(slices: DataFrame, series: str, position: str, centre: Column, most: int) -> DataFrame:
    """(series, y, x): rounded medians of the centres of up to ``most`` evenly spaced slices of each series."""
    rows = slices.select(series, F.col(position).cast("long").alias("p"), centre.alias("c"))
    stacks = rows.groupBy(series).agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "c"))), lambda s: s["c"]).alias("cs"))
    picked = stacks.withColumn("n", F.size("cs")).select(series, F.explode(F.when(F.col("n") > most, F.transform(even_index(F.col("n"), most), lambda i: F.get("cs", i))).otherwise(F.col("cs"))).alias("c"))
    return picked.groupBy(series).agg(F.bround(F.median("c.y")).cast("int").alias("y"), F.bround(F.median("c.x")).cast("int").alias("x"))


def crop_square(pixels: Column, h: Column, w: Column, y: Column, x: Column, size: int, pad: float = -1024.0) -> Column:
    """Pixels of a square around (y, x), ``pad`` outside of the slice."""
    row, col = lambda k: y - size // 2 + F.floor(k / size).cast("int"), lambda k: x - size // 2 + k % size
    there = lambda k: (row(k) >= 0) & (row(k) < h) & (col(k) >= 0) & (col(k) < w)
    return F.transform(F.sequence(F.lit(0), F.lit(size * size - 1)), lambda k: F.when(there(k), F.get(pixels, row(k) * w + col(k)).cast("double")).otherwise(F.lit(float(pad))))


def air_ratio(pixels: Column, h: Column, w: Column, box: Column, x_from: Column | None = None, x_to: Column | None = None, pad: float = 0.05) -> Column:
    """Share of pixels under AIR in a box widened by ``pad`` of its sides, one at least; 0 without a box."""
    wide = lambda a, b: F.greatest(F.lit(1), F.bround((box[b] - box[a]) * F.lit(pad)).cast("int"))
    y0, y1 = F.greatest(F.lit(0), box["y0"] - wide("y0", "y1")), F.least(h - 1, box["y1"] + wide("y0", "y1"))
    x0, x1 = F.greatest(F.lit(0), box["x0"] - wide("x0", "x1")), F.least(w - 1, box["x1"] + wide("x0", "x1"))
    x0 = x0 if x_from is None else F.greatest(x0, x_from)
    x1 = x1 if x_to is None else F.least(x1, x_to)
    rows = F.flatten(F.transform(F.sequence(y0, y1), lambda r: F.slice(pixels, r * w + x0 + 1, x1 - x0 + 1)))
    share = lambda r: F.size(F.filter(r, lambda v: v < AIR)) / F.size(r)
    return F.when(box.isNull() | (x1 < x0), F.lit(0.0)).otherwise(_let(rows, share))


def lateral_air_score(pixels: Column, h: Column, w: Column, band: float = 0.25) -> Column:
    """The larger air ratio of the bone's boxes in the bands at both edges; where both are 0 that of the whole
    slice's box, and 0 without bone."""
    b = F.greatest(F.lit(1), F.least(F.floor(w / 2), F.bround(F.lit(band) * w))).cast("int")
    zero = F.lit(0)
    left = air_ratio(pixels, h, w, bounding_box(pixels, w, BONE, zero, b - 1), zero, b - 1)
    right = air_ratio(pixels, h, w, bounding_box(pixels, w, BONE, w - b, w - 1), w - b, w - 1)
    both = F.greatest(left, right)
    return F.when(both > 0, both).otherwise(air_ratio(pixels, h, w, bounding_box(pixels, w)))


def block_start(scores: Column, k: int, reach: int = 5) -> Column:
    """First place of a block of k slices around the best smoothed score, clamped; the first best wins."""
    smooth = F.transform(scores, lambda _, i: _let(F.slice(scores, F.greatest(F.lit(1), i - reach + 1), F.least(i + 1, F.lit(reach + 1)) + reach), lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a)))
    best = _let(smooth, lambda s: F.array_position(s, F.array_max(s)).cast("int") - 1)
    return block_around(best, F.size(scores), k)


def pooled(pixels: Column, h: int, w: int, rows: int, cols: int) -> Column:
    """Adaptive average pooling of a slice to rows x cols, cells from floor(i * n / k) to ceil((i + 1) * n / k)."""
    edges = lambda n, k: [(i * n // k, -(-(i + 1) * n // k)) for i in range(k)]
    cells = []
    for a, b in edges(h, rows):
        for c, d in edges(w, cols):
            places = [r * w + x for r in range(a, b) for x in range(c, d)]
            total = F.lit(0.0)
            for p in places:
                total = total + F.get(pixels, p).cast("double")
            cells.append(total / float(len(places)))
    return F.array(*cells)


# What walks neighbours or resamples, for one slice as a NumPy array.


def canonical(img: np.ndarray, orientation: Sequence[float] | None, spacing: tuple) -> tuple[np.ndarray, tuple]:
    """The slice with rows along patient y and columns along patient x, both rising, and its (y, x) spacing.

    Slices without six cosines, strongly oblique ones and such with both axes alike stay as they are.
    """
    if orientation is None or len(orientation) < 6:
        return img, spacing
    col, row = np.asarray(orientation[:3], float), np.asarray(orientation[3:6], float)
    main = lambda v: int(abs(v[1]) > abs(v[0]))
    if abs(col[2]) > 0.2 or abs(row[2]) > 0.2 or main(col) == main(row):
        return img, spacing
    if main(col) == 1:
        img, col, row, spacing = img.T, row, col, spacing[::-1]
    return img[:: -1 if row[1] < 0 else 1, :: -1 if col[0] < 0 else 1], spacing


def largest_component(mask: np.ndarray, band: float = 0.6, least: int = 300) -> tuple[int, int, int, int] | None:
    """Box of the largest part of the mask, connected by edges, within the left ``band`` of the width.

    Parts under ``least`` pixels count only if there is no other; the first in row order wins ties. Without a
    part in the band it is the box of the whole mask, and nothing for an empty mask.
    """
    h, w = mask.shape
    width = max(1, min(w, round(band * w)))
    up: list[int] = []
    boxes: list[list[int]] = []  # size, y0, y1, x0, x1 by run

    def find(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    last: list[tuple[int, int, int]] = []
    for y in range(h):
        line = np.flatnonzero(np.diff(np.r_[False, mask[y, :width], False].astype(np.int8)))
        now = []
        for a, b in zip(line[::2].tolist(), line[1::2].tolist()):
            i = len(up)
            up.append(i)
            boxes.append([b - a, y, y, a, b - 1])
            for c, d, j in last:
                if c < b and a < d and (r := find(j)) != (s := find(i)):
                    keep, gone = min(r, s), max(r, s)
                    up[gone] = keep
                    p, q = boxes[keep], boxes[gone]
                    boxes[keep] = [p[0] + q[0], min(p[1], q[1]), max(p[2], q[2]), min(p[3], q[3]), max(p[4], q[4])]
            now.append((a, b, i))
        last = now
    roots = [i for i in range(len(up)) if find(i) == i]
    if not roots:
        ys, xs = np.nonzero(mask)
        return (int(ys.min()), int(ys.max()), int(xs.min()), int(xs.max())) if len(ys) else None
    wide = [i for i in roots if boxes[i][0] >= least] or roots
    return tuple(boxes[max(wide, key=lambda i: (boxes[i][0], -i))][1:])


def resample(img: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    """Bilinear resampling with pixel centres at halves, edges repeated."""

    def axis(n: int, m: int):
        at = np.clip((np.arange(m) + 0.5) * n / m - 0.5, 0, None)
        low = np.minimum(at.astype(int), n - 1)
        return low, np.minimum(low + 1, n - 1), at - low

    (y0, y1, fy), (x0, x1, fx) = axis(img.shape[0], shape[0]), axis(img.shape[1], shape[1])
    img = img.astype(np.float64)
    top = img[y0][:, x0] * (1 - fx) + img[y0][:, x1] * fx
    low = img[y1][:, x0] * (1 - fx) + img[y1][:, x1] * fx
    return (top * (1 - fy)[:, None] + low * fy[:, None]).astype(np.float32)


def to_spacing(img: np.ndarray, spacing: tuple, target: float) -> np.ndarray:
    """The slice resampled to a target spacing; unknown or impossible spacings leave it alone."""
    if target <= 0 or any(s is None or not math.isfinite(s) or s <= 0 for s in spacing):
        return img
    shape = tuple(max(1, round(n * s / target)) for n, s in zip(img.shape, spacing))
    return img if shape == img.shape else resample(img, shape)


@dataclass(frozen=True)
class VolumeSpec:
    """How volumes are built from a series."""

    slices: int = 32
    size: int = 224
    crop: int = 192
    block: int | None = None  # length of the block around the best air score; none takes all slices
    mirror: bool = True
    midline_slices: int = 5
    pad: float = -1024.0
    spacing: float = 0.0  # in-plane target; 0 leaves spacings alone
    z_spacing: float = 0.0  # target between slices; 0 takes slices as they are
    band: float = 0.6
    bias: float = 0.25
    least: int = 300
    lateral: float = 0.0  # share of the width on either side that a slice is scored by; 0 scores it as a whole
    probes: int = 0  # slices that are scored at most, at an even stride; 0 scores all
    window: tuple[float, float] | None = None  # centre and width that values are clipped to and scaled by; none keeps them
    window2: tuple[float, float] | None = None  # a second one, as a channel of its own
    pair: bool = False  # channels of a side are its own, the other's and their absolute differences


#: How volumes of whole units are built by default.
DUAL = VolumeSpec(block=64, spacing=0.7, z_spacing=0.8, lateral=0.25, probes=128, window=(700.0, 4000.0))


def even_places(n: int, k: int) -> list[int]:
    """k evenly spaced places of 0..n-1, truncated, the last repeated where n is below k."""
    return [i * (n - 1) // (k - 1) if k > 1 else 0 for i in range(k)] if n >= k else [*range(n), *[n - 1] * (k - n)]


def _centre(img: np.ndarray, spec: VolumeSpec) -> tuple[int, int]:
    box = largest_component(img > BONE, spec.band, spec.least)
    if box is None:
        return img.shape[0] // 2, img.shape[1] // 2
    y0, y1, x0, x1 = box
    return round((y0 + y1) / 2), round(x0 + spec.bias * max(1, x1 - x0))


def _cut(img: np.ndarray, y: int, x: int, spec: VolumeSpec) -> np.ndarray:
    out, half = np.full((spec.crop, spec.crop), spec.pad, np.float32), spec.crop // 2
    ys, xs = np.arange(spec.crop) + y - half, np.arange(spec.crop) + x - half
    iy, ix = np.flatnonzero((ys >= 0) & (ys < img.shape[0])), np.flatnonzero((xs >= 0) & (xs < img.shape[1]))
    if len(iy) and len(ix):
        out[np.ix_(iy, ix)] = img[np.ix_(ys[iy], xs[ix])]
    return out


def _air(img: np.ndarray, spec: VolumeSpec) -> float:
    ys, xs = np.nonzero(img > BONE)
    return float((img[ys.min() : ys.max() + 1, xs.min() : xs.max() + 1] < AIR).mean()) if len(ys) else 0.0


def _box_air(img: np.ndarray, bone: np.ndarray, low: int, high: int) -> float:
    """Share of air in the box of the bone in columns low to high - 1, a twentieth wider on each side within them; 0 without bone."""
    ys, xs = np.nonzero(bone[:, low:high])
    if not len(ys):
        return 0.0
    y0, y1, x0, x1 = ys.min(), ys.max(), xs.min() + low, xs.max() + low
    dy, dx = (max(1, round(float(b - a) * 0.05)) for a, b in ((y0, y1), (x0, x1)))
    part = img[max(0, y0 - dy) : y1 + dy + 1, max(low, x0 - dx) : min(high, x1 + dx + 1)]
    return float((part < AIR).mean()) if part.size else 0.0


def lateral_air(img: np.ndarray, share: float) -> float:
    """The larger share of air around bone in the bands at both sides, ``share`` of the width each; else that of the slice."""
    w, bone = img.shape[1], img > BONE
    band = max(1, min(w // 2, round(share * w)))
    return max(_box_air(img, bone, 0, band), _box_air(img, bone, w - band, w)) or _box_air(img, bone, 0, w)


def scaled(x: np.ndarray, window: tuple[float, float]) -> np.ndarray:
    """Values clipped to a window (centre, width) and scaled to 0..1."""
    low, high = window[0] - window[1] / 2, window[0] + window[1] / 2
    return ((np.clip(x, low, high) - low) / (high - low + 1e-6)).astype(np.float32)


def channels(sides: dict[str, np.ndarray], spec: VolumeSpec) -> dict[str, np.ndarray]:
    """Volumes as they are stored: as they are without a window, else (channels, slices, size, size) by windows, with
    ``pair`` three times as many."""
    windows = [w for w in (spec.window, spec.window2) if w is not None and w[1] > 0]
    if not windows:
        if spec.pair:
            raise ValueError("pair features need a window")
        return sides
    own = {k: np.stack([scaled(v, w) for w in windows]) for k, v in sides.items()}
    if not spec.pair:
        return own
    apart = np.abs(own["left"] - own["right"])
    return {"left": np.concatenate([own["left"], own["right"], apart]), "right": np.concatenate([own["right"], own["left"], apart])}


def _stack(images: list[np.ndarray], z: np.ndarray, spec: VolumeSpec) -> list[np.ndarray]:
    """The slices of the volume: a block or all, at even places or interpolated on an even z grid."""
    n = len(images)
    first, last = 0, n - 1
    if spec.block and n > (length := max(spec.block, spec.slices)):
        at = range(0, n, max(1, n // spec.probes) if spec.probes else 1)
        scores = np.array([lateral_air(images[i], spec.lateral) if spec.lateral else _air(images[i], spec) for i in at])
        smooth = np.array([scores[max(0, j - 5) : j + 6].mean() for j in range(len(at))])
        first = max(0, min(n - length, at[int(np.argmax(smooth))] - length // 2))
        last = first + length - 1
    known = np.isfinite(z[first : last + 1])
    if spec.z_spacing > 0 and known.all() and last > first and z[last] > z[first]:
        grid = z[first] + (z[last] - z[first]) / 2 + (np.arange(spec.slices) - (spec.slices - 1) / 2) * spec.z_spacing
        at = np.interp(grid, np.maximum.accumulate(z[first : last + 1]), np.arange(first, last + 1))
        low = np.minimum(at.astype(int), last)
        high = np.minimum(low + 1, last)
        return [images[a] if a == b else (images[a] * (1 - f) + images[b] * f).astype(np.float32) for a, b, f in zip(low, high, at - low)]
    return [images[first + i] for i in even_places(last - first + 1, spec.slices)]


def build_volume(images: list[np.ndarray], z: np.ndarray, spacings: list[tuple], spec: VolumeSpec) -> dict[str, np.ndarray]:
    """Volumes of both sides from the ordered slices of a series: (slices, size, size), with windows (channels, slices, size, size)."""
    images = [to_spacing(i.astype(np.float32), s, spec.spacing) for i, s in zip(images, spacings)]
    stack = _stack(images, z, spec)
    probes = [stack[i] for i in sorted(set(even_places(len(stack), min(spec.midline_slices, len(stack)))))]
    means = [np.nonzero(i > BONE)[1].mean() for i in probes if (i > BONE).any()]
    mid = round(float(np.median(means))) if means else None
    sides: dict[str, list] = {"left": [], "right": []}
    for img in stack:
        m = max(1, min(img.shape[1] - 1, img.shape[1] // 2 if mid is None else mid))
        sides["left"].append(img[:, :m])
        sides["right"].append(img[:, m:][:, ::-1] if spec.mirror else img[:, m:])
    out = {}
    for side, imgs in sides.items():
        centres = np.array([_centre(i, spec) for i in imgs])
        y, x = round(float(np.median(centres[:, 0]))), round(float(np.median(centres[:, 1])))
        out[side] = np.stack([resample(_cut(i, y, x, spec), (spec.size, spec.size)) for i in imgs])
    return channels(out, spec)


def volumes(slices: DataFrame, series: str, spec: VolumeSpec, whole_units: bool = False) -> DataFrame:
    """(series, side, shape, data): little-endian half-precision volumes of each series.

    ``slices`` has series, path, pixels, h, w and z, instance, spacing_y, spacing_x, which may be null. With
    ``whole_units`` a series is one row of side ``both``, left before right. A series is one group.
    """
    kind = slices.schema[series].dataType.simpleString()
    rows = slices.select(series, slice_order(F.col("z"), F.col("instance"), F.col("path")).alias("o"), "pixels", "h", "w", F.col("z").cast("double").alias("z"), F.col("spacing_y").cast("double").alias("sy"), F.col("spacing_x").cast("double").alias("sx"))
    rows = rows.select(series, "o.rank", "o.key", "o.tie", "pixels", "h", "w", "z", "sy", "sx")

    def build(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values(["rank", "key", "tie"], kind="stable")
        images = [np.asarray(p, np.float32).reshape(h, w) for p, h, w in zip(b["pixels"], b["h"], b["w"])]
        spacings = [(None if math.isnan(y) else y, None if math.isnan(x) else x) for y, x in zip(b["sy"].astype(float), b["sx"].astype(float))]
        got = build_volume(images, b["z"].to_numpy(float), spacings, spec)
        sides = {"both": np.stack([got["left"], got["right"]])} if whole_units else got
        return pd.DataFrame([(b[series].iloc[0], s, list(v.shape), v.astype("<f2").tobytes()) for s, v in sides.items()], columns=[series, "side", "shape", "data"])

    return rows.groupBy(series).applyInPandas(build, f"`{series}` {kind}, side string, shape array<int>, data binary")
