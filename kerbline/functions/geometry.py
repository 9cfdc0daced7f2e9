"""Plane geometry as column expressions.

A segment is four double columns (x1, y1, x2, y2) and stays inside whole-stage code generation.
A polyline or ring is ``array<struct<x:double,y:double>>``; rings are open (the last vertex joins
the first) and may have either orientation.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kerbline.functions import planar

EARTH_RADIUS_M = 6371000.0
DEGREE_M = 111000.0


def _c(value) -> Column:
    return F.col(value) if isinstance(value, str) else (value if isinstance(value, Column) else F.lit(float(value)))


def _all(*values) -> list[Column]:
    return [_c(v) for v in values]


def clamp(x, low: float, high: float) -> Column:
    """``x`` kept within bounds; a missing value stays missing."""
    return F.when(_c(x).isNotNull(), F.least(F.greatest(_c(x), _c(low)), _c(high)))


def r_to(x, digits: int = 6) -> Column:
    """Rounded value without a negative zero, for results compared across engines."""
    return F.round(_c(x), digits) + F.lit(0.0)


# --- segments ---------------------------------------------------------------------------------


def distance(x1, y1, x2, y2) -> Column:
    x1, y1, x2, y2 = _all(x1, y1, x2, y2)
    return F.sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1))


def point_segment_distance(px, py, x1, y1, x2, y2) -> Column:
    """Distance of a point and a segment, which may be a single point.

    A filter repeats the whole formula wherever a part of it occurs, and code of over 8000 bytes is not compiled, so
    the position along the segment is written without branches: for a single point it is 0 over the least number.
    """
    px, py, x1, y1, x2, y2 = _all(px, py, x1, y1, x2, y2)
    dx, dy = x2 - x1, y2 - y1
    along = ((px - x1) * dx + (py - y1) * dy) / F.greatest(dx * dx + dy * dy, F.lit(5e-324))
    t = F.least(F.greatest(along, F.lit(0.0)), F.lit(1.0))
    return distance(px, py, x1 + t * dx, y1 + t * dy)


def cross(ax, ay, bx, by, cx, cy) -> Column:
    """Twice the signed area of triangle a, b, c (positive when c lies left of a→b)."""
    ax, ay, bx, by, cx, cy = _all(ax, ay, bx, by, cx, cy)
    return (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)


def segments_cross(a: tuple, b: tuple) -> Column:
    """True when the two open segments pass through each other."""
    a1 = cross(b[0], b[1], b[2], b[3], a[0], a[1])
    a2 = cross(b[0], b[1], b[2], b[3], a[2], a[3])
    b1 = cross(a[0], a[1], a[2], a[3], b[0], b[1])
    b2 = cross(a[0], a[1], a[2], a[3], b[2], b[3])
    return (F.signum(a1) * F.signum(a2) < 0) & (F.signum(b1) * F.signum(b2) < 0)


def segments_touch(a: tuple, b: tuple) -> Column:
    """True when the two closed segments share a point."""
    ax1, ay1, ax2, ay2 = _all(*a)
    bx1, by1, bx2, by2 = _all(*b)
    boxes = (
        (F.greatest(ax1, ax2) >= F.least(bx1, bx2)) & (F.greatest(bx1, bx2) >= F.least(ax1, ax2))
        & (F.greatest(ay1, ay2) >= F.least(by1, by2)) & (F.greatest(by1, by2) >= F.least(ay1, ay2))
    )
    a_split = F.signum(cross(*b, a[0], a[1])) * F.signum(cross(*b, a[2], a[3])) <= 0
    b_split = F.signum(cross(*a, b[0], b[1])) * F.signum(cross(*a, b[2], b[3])) <= 0
    return boxes & a_split & b_split


def segment_segment_distance(a: tuple, b: tuple) -> Column:
    return planar.segment_distance(*_all(*a), *_all(*b))


def angle(x1, y1, x2, y2) -> Column:
    """Bearing of first to last vertex in [0, 180); null for a degenerate segment."""
    x1, y1, x2, y2 = _all(x1, y1, x2, y2)
    dx, dy = x2 - x1, y2 - y1
    return F.when((dx != 0) | (dy != 0), F.pmod(F.degrees(F.atan2(dy, dx)), F.lit(180.0)))


def angle_diff(a, b) -> Column:
    """Undirected difference in [0, 90]; 90 when either bearing is missing."""
    d = F.abs(_c(a) - _c(b)) % F.lit(180.0)
    return F.coalesce(F.least(d, F.lit(180.0) - d), F.lit(90.0))


def capsule_interval(a: tuple, b: tuple, r) -> Column:
    """Struct (lo, hi): parameters of the part of segment ``a`` within ``r`` of segment ``b``."""
    return planar.capsule_span(*_all(*a), *_all(*b), _c(r))


def overlap_length(a: tuple, b: tuple, r) -> Column:
    """Length of the part of segment ``a`` within ``r`` of segment ``b``."""
    return planar.overlap_metres(*_all(*a), *_all(*b), _c(r))


def overlap_lengths(a: tuple, b: tuple, radii: Column) -> Column:
    """``overlap_length`` for an array of radii of fixed size; null for a null radius."""
    return planar.overlap_metres_each(*_all(*a), *_all(*b), radii)


def shared_length(a: tuple, b: tuple) -> Column:
    """Common length of two collinear segments; 0 for a point touch."""
    ax1, ay1, ax2, ay2 = _all(*a)
    dx, dy = ax2 - ax1, ay2 - ay1
    length = F.nullif(F.sqrt(dx * dx + dy * dy), F.lit(0.0))
    flat = (cross(*a, b[0], b[1]) == 0) & (cross(*a, b[2], b[3]) == 0)
    p = ((_c(b[0]) - ax1) * dx + (_c(b[1]) - ay1) * dy) / length
    q = ((_c(b[2]) - ax1) * dx + (_c(b[3]) - ay1) * dy) / length
    common = F.least(F.greatest(p, q), length) - F.greatest(F.least(p, q), F.lit(0.0))
    return F.when(flat, F.greatest(F.coalesce(common, F.lit(0.0)), F.lit(0.0))).otherwise(F.lit(0.0))


def half_sides(px, py, x1, y1, x2, y2, r) -> tuple[Column, Column]:
    """Whether a point is in the (left, right) half-side of a segment.

    A side is what lies within ``r`` both of the segment and of the segment moved r/2 to that
    side, so the two sides overlap near the axis.
    """
    s = planar.sides(*_all(px, py, x1, y1, x2, y2), _c(r))
    return s.getField("left"), s.getField("right")


# --- polylines and rings ------------------------------------------------------------------------


def point(x, y) -> Column:
    x, y = _all(x, y)
    return F.struct(x.alias("x"), y.alias("y"))


def line(*xy) -> Column:
    """Array geometry from pairs of coordinate columns."""
    return F.array(*[point(x, y) for x, y in xy])


def edges_of(geom, closed: bool = False) -> Column:
    """array<struct<x1,y1,x2,y2>> of consecutive vertices (plus last to first when closed)."""
    geom = _c(geom)
    nxt = F.slice(geom, F.lit(2), F.greatest(F.size(geom) - 1, F.lit(0)))
    if closed:
        nxt = F.concat(nxt, F.slice(geom, 1, 1))
        base = geom
    else:
        base = F.slice(geom, F.lit(1), F.greatest(F.size(geom) - 1, F.lit(0)))
    return F.zip_with(
        base,
        nxt,
        lambda p, q: F.struct(p.x.alias("x1"), p.y.alias("y1"), q.x.alias("x2"), q.y.alias("y2")),
    )


def _sum(array: Column, fn) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda acc, e: acc + fn(e))


def line_length(geom) -> Column:
    return _sum(edges_of(geom), lambda e: distance(e.x1, e.y1, e.x2, e.y2))


def line_midpoint(geom) -> Column:
    """Point at half the length of a polyline."""
    edges = edges_of(geom)
    half = line_length(geom) / 2
    start = F.struct(F.lit(0.0).alias("run"), F.lit(None).cast("double").alias("x"), F.lit(None).cast("double").alias("y"))

    def step(acc, e):
        length = distance(e.x1, e.y1, e.x2, e.y2)
        t = (half - acc.run) / F.nullif(length, F.lit(0.0))
        here = acc.x.isNull() & (acc.run + length >= half) & (length > 0)
        return F.struct(
            (acc.run + length).alias("run"),
            F.when(here, e.x1 + t * (e.x2 - e.x1)).otherwise(acc.x).alias("x"),
            F.when(here, e.y1 + t * (e.y2 - e.y1)).otherwise(acc.y).alias("y"),
        )

    return F.aggregate(edges, start, step, lambda acc: F.struct(acc.x.alias("x"), acc.y.alias("y")))


def line_angle(geom) -> Column:
    geom = _c(geom)
    a, b = F.element_at(geom, 1), F.element_at(geom, -1)
    return F.when(F.size(geom) >= 2, angle(a.x, a.y, b.x, b.y))


def longest_part(parts) -> Column:
    """The longest polyline of a multi-part line (first on ties)."""
    parts = _c(parts)
    return F.aggregate(
        parts,
        F.element_at(parts, 1),
        lambda best, g: F.when(line_length(g) > line_length(best), g).otherwise(best),
    )


def start_point(geom) -> Column:
    return F.element_at(_c(geom), 1)


def mid_vertex(geom) -> Column:
    """Vertex at index n/2 (counted from 0)."""
    geom = _c(geom)
    return F.element_at(geom, F.floor(F.size(geom) / 2).cast("int") + 1)


def round_coords(geom, digits: int = 5) -> Column:
    return F.transform(_c(geom), lambda p: point(r_to(p.x, digits), r_to(p.y, digits)))


def point_line_distance(px, py, geom) -> Column:
    return F.array_min(
        F.transform(edges_of(geom), lambda e: point_segment_distance(px, py, e.x1, e.y1, e.x2, e.y2))
    )


def ring_area2(ring) -> Column:
    """Twice the signed area of a ring (positive when counter-clockwise)."""
    return _sum(edges_of(ring, True), lambda e: e.x1 * e.y2 - e.x2 * e.y1)


def point_in_ring(px, py, ring) -> Column:
    """Even-odd test."""
    px, py = _all(px, py)

    def hit(e):
        straddles = (e.y1 > py) != (e.y2 > py)
        at = (e.x2 - e.x1) * (py - e.y1) / F.nullif(e.y2 - e.y1, F.lit(0.0)) + e.x1
        return F.when(straddles & (px < at), 1.0).otherwise(0.0)

    return _sum(edges_of(ring, True), hit) % 2 == 1


def point_in_polygon(px, py, rings) -> Column:
    """Even-odd test over an outer ring and its holes (``array<array<point>>``)."""
    return F.aggregate(
        _c(rings), F.lit(False), lambda acc, ring: acc != point_in_ring(px, py, ring)
    )


def length_in_ring(x1, y1, x2, y2, ring) -> Column:
    """Length of a segment inside a ring.

    The segment is cut where it meets the ring's edges, and a piece counts when its middle lies
    inside. A cut too many does no harm, so a segment through a corner needs no rule of its own.
    """
    x1, y1, x2, y2 = _all(x1, y1, x2, y2)
    dx, dy = x2 - x1, y2 - y1

    def cut(e):
        ex, ey = e.x2 - e.x1, e.y2 - e.y1
        den = F.nullif(dx * ey - dy * ex, F.lit(0.0))
        t = ((e.x1 - x1) * ey - (e.y1 - y1) * ex) / den
        s = ((e.x1 - x1) * dy - (e.y1 - y1) * dx) / den
        return F.when((s >= 0) & (s <= 1), t)

    cuts = F.filter(F.transform(edges_of(ring, True), cut), lambda t: (t > 0) & (t < 1))
    size = F.sqrt(dx * dx + dy * dy)

    def add(acc, t):
        inside = point_in_ring(x1 + dx * (acc.t + t) / 2, y1 + dy * (acc.t + t) / 2, ring)
        return F.struct(t.alias("t"), (acc.m + F.when((t > acc.t) & inside, (t - acc.t) * size).otherwise(0.0)).alias("m"))

    ends = F.array_sort(F.concat(cuts, F.array(F.lit(1.0))))
    return F.aggregate(ends, F.struct(F.lit(0.0).alias("t"), F.lit(0.0).alias("m")), add, lambda acc: acc.m)


def segment_meets_ring(x1, y1, x2, y2, ring) -> Column:
    """True when a segment touches the area of a ring."""
    crosses = F.exists(
        edges_of(ring, True),
        lambda e: segments_touch((x1, y1, x2, y2), (e.x1, e.y1, e.x2, e.y2)),
    )
    return point_in_ring(x1, y1, ring) | crosses


def rings_meet(a, b) -> Column:
    """True when two ring areas share a point."""
    a, b = _all(a, b)
    edge_hit = F.exists(
        edges_of(a, True),
        lambda e: F.exists(
            edges_of(b, True),
            lambda g: segments_touch((e.x1, e.y1, e.x2, e.y2), (g.x1, g.y1, g.x2, g.y2)),
        ),
    )
    pa, pb = F.element_at(a, 1), F.element_at(b, 1)
    return edge_hit | point_in_ring(pa.x, pa.y, b) | point_in_ring(pb.x, pb.y, a)


def line_centroid(geom) -> Column:
    """Length-weighted mean of the segment midpoints."""
    edges = edges_of(geom)
    total = F.nullif(line_length(geom), F.lit(0.0))
    x = _sum(edges, lambda e: (e.x1 + e.x2) / 2 * distance(e.x1, e.y1, e.x2, e.y2)) / total
    y = _sum(edges, lambda e: (e.y1 + e.y2) / 2 * distance(e.x1, e.y1, e.x2, e.y2)) / total
    return F.struct(x.alias("x"), y.alias("y"))


def ring_centroid(ring) -> Column:
    """Area-weighted centroid of a ring."""
    edges = edges_of(ring, True)
    area6 = F.nullif(ring_area2(ring) * 3, F.lit(0.0))
    x = _sum(edges, lambda e: (e.x1 + e.x2) * (e.x1 * e.y2 - e.x2 * e.y1)) / area6
    y = _sum(edges, lambda e: (e.y1 + e.y2) * (e.x1 * e.y2 - e.x2 * e.y1)) / area6
    return F.struct(x.alias("x"), y.alias("y"))


# --- angles on the globe ------------------------------------------------------------------------


def haversine(lat1, lon1, lat2, lon2) -> Column:
    lat1, lon1, lat2, lon2 = [F.radians(c) for c in _all(lat1, lon1, lat2, lon2)]
    s1, s2 = F.sin((lat2 - lat1) / 2), F.sin((lon2 - lon1) / 2)
    h = s1 * s1 + F.cos(lat1) * F.cos(lat2) * s2 * s2
    return F.lit(2 * EARTH_RADIUS_M) * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def planar_xy(lat, lon, mean_lat) -> tuple[Column, Column]:
    """Local metric plane around a mean latitude."""
    return _c(lon) * DEGREE_M * F.cos(F.radians(_c(mean_lat))), _c(lat) * DEGREE_M


def cos_scaled(lat, lon, at_lat: float = 37.55) -> tuple[Column, Column]:
    """Degrees with longitude shrunk by the cosine of a fixed latitude."""
    return _c(lon) * F.cos(F.radians(F.lit(at_lat))), _c(lat)
