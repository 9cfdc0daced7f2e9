"""Segment-pair measures on Arrow batches.

Overlaps and side tests are long formulas over eight coordinates; as column expressions they
outgrow whole-stage code generation, so they run as vectorised numpy over the joined pairs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, StructField, StructType

SPAN = StructType([StructField("lo", DoubleType()), StructField("hi", DoubleType())])
SIDES = StructType([StructField("left", BooleanType()), StructField("right", BooleanType())])


def point_segment(px, py, x1, y1, x2, y2):
    dx, dy = x2 - x1, y2 - y1
    size = dx * dx + dy * dy
    t = np.clip(((px - x1) * dx + (py - y1) * dy) / np.where(size > 0, size, 1.0), 0.0, 1.0)
    t = np.where(size > 0, t, 0.0)
    ex, ey = x1 + t * dx - px, y1 + t * dy - py
    return np.sqrt(ex * ex + ey * ey)


def _turn(ax, ay, bx, by, cx, cy):
    return (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)


def segment_segment(a, b):
    through = (np.sign(_turn(*b, a[0], a[1])) * np.sign(_turn(*b, a[2], a[3])) < 0) & (
        np.sign(_turn(*a, b[0], b[1])) * np.sign(_turn(*a, b[2], b[3])) < 0
    )
    ends = [point_segment(a[0], a[1], *b), point_segment(a[2], a[3], *b), point_segment(b[0], b[1], *a), point_segment(b[2], b[3], *a)]
    return np.where(through, 0.0, np.minimum.reduce(ends))


def clip_span(a, b, r):
    """Parameters of the part of segment ``a`` within ``r`` of segment ``b``; NaN when there is none.

    The surroundings of a segment are convex, so the part is one interval: the hull of what its two
    end discs and the rectangle between them cut out.
    """
    ax, ay, bx, by = a[0], a[1], b[0], b[1]
    dx, dy = a[2] - ax, a[3] - ay
    ex, ey = b[2] - bx, b[3] - by
    n = dx * dx + dy * dy
    along = np.sqrt(ex * ex + ey * ey)
    with np.errstate(divide="ignore", invalid="ignore"):
        spans = []
        for cx, cy in ((bx, by), (b[2], b[3])):
            fx, fy = ax - cx, ay - cy
            half = fx * dx + fy * dy
            root = np.sqrt(half * half - n * (fx * fx + fy * fy - r * r))
            spans.append(((-half - root) / n, (-half + root) / n))
        limits = []
        for start, slope, low, high in (
            (((ay - by) * ex - (ax - bx) * ey) / along, (dy * ex - dx * ey) / along, -r, r),
            (((ax - bx) * ex + (ay - by) * ey) / along, (dx * ex + dy * ey) / along, 0.0 * r, along),
        ):
            t1, t2 = (low - start) / slope, (high - start) / slope
            flat = slope == 0
            inside = (start >= low) & (start <= high)
            limits.append((
                np.where(flat, np.where(inside, 0.0, np.nan), np.minimum(t1, t2)),
                np.where(flat, np.where(inside, 1.0, np.nan), np.maximum(t1, t2)),
            ))
        spans.append((np.maximum(limits[0][0], limits[1][0]), np.minimum(limits[0][1], limits[1][1])))
        lows, highs = [], []
        for lo, hi in spans:
            lo, hi = np.maximum(lo, 0.0), np.minimum(hi, 1.0)
            ok = lo <= hi
            lows.append(np.where(ok, lo, np.nan))
            highs.append(np.where(ok, hi, np.nan))
    return np.fmin.reduce(lows), np.fmax.reduce(highs)


def _arrays(series):
    return [s.to_numpy(dtype=float) for s in series]


@F.pandas_udf(DoubleType())
def segment_distance(
    a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series, e: pd.Series, f: pd.Series, g: pd.Series, h: pd.Series
) -> pd.Series:
    v = _arrays((a, b, c, d, e, f, g, h))
    return pd.Series(segment_segment(v[:4], v[4:]))


@F.pandas_udf(SPAN)
def capsule_span(
    a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series, e: pd.Series, f: pd.Series, g: pd.Series, h: pd.Series, r: pd.Series
) -> pd.DataFrame:
    v = _arrays((a, b, c, d, e, f, g, h, r))
    lo, hi = clip_span(v[:4], v[4:8], v[8])
    return pd.DataFrame({"lo": pd.Series(lo).astype("Float64"), "hi": pd.Series(hi).astype("Float64")})


@F.pandas_udf(DoubleType())
def overlap_metres(
    a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series, e: pd.Series, f: pd.Series, g: pd.Series, h: pd.Series, r: pd.Series
) -> pd.Series:
    v = _arrays((a, b, c, d, e, f, g, h, r))
    lo, hi = clip_span(v[:4], v[4:8], v[8])
    length = np.sqrt((v[2] - v[0]) ** 2 + (v[3] - v[1]) ** 2)
    return pd.Series(np.nan_to_num((hi - lo) * length, nan=0.0))


@F.pandas_udf(ArrayType(DoubleType()))
def overlap_metres_each(
    a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series, e: pd.Series, f: pd.Series, g: pd.Series, h: pd.Series, r: pd.Series
) -> pd.Series:
    """``overlap_metres`` for every radius of an array of fixed size; null for a null radius."""
    if not len(r):
        return pd.Series([], dtype=object)
    v, radii = _arrays((a, b, c, d, e, f, g, h)), np.stack(r.to_numpy()).astype(float)
    row, place = np.nonzero(~np.isnan(radii))
    out = np.full(radii.shape, np.nan)
    w = [x[row] for x in v]
    lo, hi = clip_span(w[:4], w[4:], radii[row, place])
    out[row, place] = np.nan_to_num((hi - lo) * np.sqrt((w[2] - w[0]) ** 2 + (w[3] - w[1]) ** 2), nan=0.0)
    return pd.Series(list(out))


@F.pandas_udf(SIDES)
def sides(
    px: pd.Series, py: pd.Series, x1: pd.Series, y1: pd.Series, x2: pd.Series, y2: pd.Series, r: pd.Series
) -> pd.DataFrame:
    px, py, x1, y1, x2, y2, r = _arrays((px, py, x1, y1, x2, y2, r))
    length = np.sqrt((x2 - x1) ** 2 + (y2 - y1) ** 2)
    safe = np.where(length > 0, length, 1.0)
    nx, ny = -(y2 - y1) / safe * r / 2, (x2 - x1) / safe * r / 2
    near = (point_segment(px, py, x1, y1, x2, y2) <= r) & (length > 0)
    left = near & (point_segment(px, py, x1 + nx, y1 + ny, x2 + nx, y2 + ny) <= r)
    right = near & (point_segment(px, py, x1 - nx, y1 - ny, x2 - nx, y2 - ny) <= r)
    return pd.DataFrame({"left": left, "right": right})
