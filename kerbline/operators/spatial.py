"""Spatial joins on a grid of square cells.

Points fall in one cell; segments and boxes are listed in every cell their padded extent touches.
A spatial join is then an equi-join on the cell, followed by the exact predicate. Hot cells are
salted, so a dense place is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbline.functions import geometry as G
from kerbline.operators.skew import salt_pair
from kerbline.session import cut_lineage

SEG = ("x1", "y1", "x2", "y2")


def _cell(value: Column, size: float) -> Column:
    return F.floor(value / F.lit(float(size))).cast("long")


def point_cells(df: DataFrame, x: str, y: str, cell: float) -> DataFrame:
    return df.withColumn("_cx", _cell(F.col(x), cell)).withColumn("_cy", _cell(F.col(y), cell))


def segment_cells(df: DataFrame, cell: float, pad: float = 0.0, seg: tuple = SEG) -> DataFrame:
    """List each segment in the cells within ``pad`` of it, column of cells by column."""
    x1, y1, x2, y2 = (F.col(c) for c in seg)
    df = df.withColumn(
        "_cx",
        F.explode(F.sequence(_cell(F.least(x1, x2) - pad, cell), _cell(F.greatest(x1, x2) + pad, cell))),
    )
    dx = F.nullif(x2 - x1, F.lit(0.0))
    ta = (F.col("_cx") * F.lit(float(cell)) - pad - x1) / dx
    tb = ((F.col("_cx") + 1) * F.lit(float(cell)) + pad - x1) / dx
    lo = F.coalesce(G.clamp(F.least(ta, tb), 0.0, 1.0), F.lit(0.0))
    hi = F.coalesce(G.clamp(F.greatest(ta, tb), 0.0, 1.0), F.lit(1.0))
    ya, yb = y1 + lo * (y2 - y1), y1 + hi * (y2 - y1)
    return df.withColumn(
        "_cy", F.explode(F.sequence(_cell(F.least(ya, yb) - pad, cell), _cell(F.greatest(ya, yb) + pad, cell)))
    )


def box_cells(df: DataFrame, side: str, cell: float, pad: float, box: tuple[Column, Column, Column, Column]) -> DataFrame:
    """List each box in every cell its padded extent touches.

    The padded box (``_{side}x0`` …) and its first cell (``_{side}fx``, ``_{side}fy``) stay beside it.
    """
    x0, y0, x1, y1 = (f"_{side}{n}" for n in ("x0", "y0", "x1", "y1"))
    return (
        df.withColumns({x0: box[0] - pad, y0: box[1] - pad, x1: box[2] + pad, y1: box[3] + pad})
        .withColumn(f"_{side}fx", _cell(F.col(x0), cell)).withColumn(f"_{side}fy", _cell(F.col(y0), cell))
        .withColumn("_cx", F.explode(F.sequence(F.col(f"_{side}fx"), _cell(F.col(x1), cell))))
        .withColumn("_cy", F.explode(F.sequence(F.col(f"_{side}fy"), _cell(F.col(y1), cell))))
    )


def _pair_once() -> Column:
    """Boxes a and b overlap and this is the lower-left cell they share."""
    overlap = (F.col("_ax1") >= F.col("_bx0")) & (F.col("_bx1") >= F.col("_ax0")) & (F.col("_ay1") >= F.col("_by0")) & (F.col("_by1") >= F.col("_ay0"))
    return overlap & (F.col("_cx") == F.greatest("_afx", "_bfx")) & (F.col("_cy") == F.greatest("_afy", "_bfy"))


_HELPERS = [f"_{s}{n}" for s in "ab" for n in ("x0", "y0", "x1", "y1", "fx", "fy")]


def _seg_box(seg: tuple) -> tuple[Column, Column, Column, Column]:
    x1, y1, x2, y2 = (F.col(c) for c in seg)
    return F.least(x1, x2), F.least(y1, y2), F.greatest(x1, x2), F.greatest(y1, y2)


def _ring_box(ring: str) -> tuple[Column, Column, Column, Column]:
    xs = F.transform(ring, lambda p: p.x)
    ys = F.transform(ring, lambda p: p.y)
    return F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)


def line_segments(df: DataFrame, geom: str, keep: list[str]) -> DataFrame:
    """One row per segment of an array geometry, with its position."""
    return df.select(*keep, F.posexplode(G.edges_of(F.col(geom))).alias("seq", "e")).select(
        *keep, "seq", "e.x1", "e.y1", "e.x2", "e.y2"
    )


# --- points and segments --------------------------------------------------------------------------


def points_near_segments(
    points: DataFrame, segments: DataFrame, radius: float, point_id: str, x: str = "x", y: str = "y",
    cell: float | None = None,
) -> DataFrame:
    """All (point, segment) pairs within ``radius``, with ``distance``.

    Both inputs keep their columns, so names must differ between them.
    """
    cell = cell or max(radius, 1.0)
    left = point_cells(points, x, y, cell)
    right = segment_cells(segments, cell, radius)
    left, right, on = salt_pair(left, right, ["_cx", "_cy"], [point_id])
    return (
        left.join(right, on)
        .withColumn("distance", G.point_segment_distance(x, y, *SEG))
        .filter(F.col("distance") <= radius)
        .drop(*on)
    )


def count_within(
    points: DataFrame, segments: DataFrame, radius: float, point_id: str, line_id: str, out: str = "n",
) -> DataFrame:
    """Per line, how many points lie within ``radius`` (a line of many segments counts a point once)."""
    pairs = points_near_segments(points.select(point_id, "x", "y"), segments.select(line_id, *SEG), radius, point_id)
    return pairs.select(line_id, point_id).distinct().groupBy(line_id).agg(F.count("*").alias(out))


def nearest_within(
    points: DataFrame, segments: DataFrame, radius: float, point_id: str, line_id: str, x: str = "x", y: str = "y",
    carry: list[str] = (),
) -> DataFrame:
    """Each point's nearest line within ``radius`` (ties: smaller id); unmatched points are absent.

    Returns point_id, line_id, distance and the ``carry`` columns of the line.
    """
    pairs = points_near_segments(
        points.select(point_id, x, y), segments.select(line_id, *SEG, *carry), radius, point_id, x, y
    )
    best = pairs.groupBy(point_id).agg(F.min(F.struct("distance", line_id, *carry)).alias("_b"))
    return best.select(point_id, f"_b.{line_id}", "_b.distance", *[f"_b.{c}" for c in carry])


def nearest(
    points: DataFrame, segments: DataFrame, point_id: str, line_id: str, start_radius: float, x: str = "x", y: str = "y",
    carry: list[str] = (), limit: float | None = None,
) -> DataFrame:
    """Each point's nearest line at any distance, or within ``limit`` (ties: smaller id).

    A match at distance d is final when d is within the searched radius, so points are searched at
    a doubling radius and only those still without a match go on. Dense places finish in the first
    round with few candidates.
    """
    todo = points.select(point_id, x, y)
    done: list[DataFrame] = []
    reach = limit if limit is not None else _reach(points, segments, x, y)
    if reach is None:
        return nearest_within(points, segments, start_radius, point_id, line_id, x, y, carry)
    radius = float(start_radius)
    while True:
        found = nearest_within(todo, segments, radius, point_id, line_id, x, y, carry)
        merged = cut_lineage(todo.join(found, point_id, "left"))
        done.append(merged.filter(F.col("distance").isNotNull()))
        todo = merged.filter(F.col("distance").isNull()).select(point_id, x, y)
        if radius >= reach or todo.isEmpty():
            break
        radius = min(radius * 2, limit) if limit is not None else radius * 2
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out.select(point_id, line_id, "distance", *carry)


def _reach(points: DataFrame, segments: DataFrame, x: str, y: str) -> float | None:
    """A distance that no point and line exceed; None when there are no points or no lines."""
    box = segments.agg(
        F.min(F.least("x1", "x2")).alias("a"), F.max(F.greatest("x1", "x2")).alias("b"),
        F.min(F.least("y1", "y2")).alias("c"), F.max(F.greatest("y1", "y2")).alias("d"),
    ).first()
    pbox = points.agg(F.min(x).alias("a"), F.max(x).alias("b"), F.min(y).alias("c"), F.max(y).alias("d")).first()
    if box.a is None or pbox.a is None:
        return None
    return (max(box.b, pbox.b) - min(box.a, pbox.a)) + (max(box.d, pbox.d) - min(box.c, pbox.c))


def points_as_segments(df: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """Points as zero-length segments, so point-to-point searches use the same joins."""
    return df.select("*", F.col(x).alias("x1"), F.col(y).alias("y1"), F.col(x).alias("x2"), F.col(y).alias("y2"))


def segment_pairs(a: DataFrame, b: DataFrame, radius: float, a_id: str, a_seg: tuple, b_seg: tuple, cell: float | None = None) -> DataFrame:
    """All segment pairs within ``radius`` with ``distance``, each pair once.

    A pair meets in every cell both boxes touch; it is kept only in the lower-left one, which
    needs no shuffle to remove the repeats.
    """
    cell = cell or max(radius, 50.0)
    left = box_cells(a, "a", cell, 0.0, _seg_box(a_seg))
    right = box_cells(b, "b", cell, radius, _seg_box(b_seg))
    left, right, on = salt_pair(left, right, ["_cx", "_cy"], [a_id])
    return (
        left.join(right, on)
        .filter(_pair_once())
        .drop(*on, *_HELPERS)
        .withColumn("distance", G.segment_segment_distance(a_seg, b_seg))
        .filter(F.col("distance") <= radius)
    )


# --- areas ----------------------------------------------------------------------------------------


def points_in_rings(points: DataFrame, zones: DataFrame, point_id: str, ring: str = "ring", x: str = "x", y: str = "y", cell: float = 250.0) -> DataFrame:
    """(point, zone) pairs with the point inside the ring."""
    left = point_cells(points, x, y, cell)
    right = box_cells(zones, "b", cell, 0.0, _ring_box(ring))
    left, right, on = salt_pair(left, right, ["_cx", "_cy"], [point_id])
    in_box = F.col(x).between(F.col("_bx0"), F.col("_bx1")) & F.col(y).between(F.col("_by0"), F.col("_by1"))
    return left.join(right, on).filter(in_box).filter(G.point_in_ring(x, y, F.col(ring))).drop(*on, *_HELPERS)


def segments_in_rings(lines: DataFrame, zones: DataFrame, line_id: str, ring: str = "ring", cell: float = 250.0) -> DataFrame:
    """(segment, zone) pairs that meet, with ``inter_len``, the length of the segment inside."""
    left = box_cells(lines, "a", cell, 0.0, _seg_box(SEG))
    right = box_cells(zones, "b", cell, 0.0, _ring_box(ring))
    left, right, on = salt_pair(left, right, ["_cx", "_cy"], [line_id])
    return (
        left.join(right, on)
        .filter(_pair_once())
        .filter(G.segment_meets_ring(*SEG, F.col(ring)))
        .withColumn("inter_len", G.length_in_ring(*SEG, F.col(ring)))
        .drop(*on, *_HELPERS)
    )


def rings_in_rings(a: DataFrame, b: DataFrame, a_id: str, a_ring: str, b_ring: str, cell: float = 250.0) -> DataFrame:
    """(a, b) pairs of areas that share a point, each once."""
    left = box_cells(a, "a", cell, 0.0, _ring_box(a_ring))
    right = box_cells(b, "b", cell, 0.0, _ring_box(b_ring))
    left, right, on = salt_pair(left, right, ["_cx", "_cy"], [a_id])
    return left.join(right, on).filter(_pair_once()).filter(G.rings_meet(F.col(a_ring), F.col(b_ring))).drop(*on, *_HELPERS)


def meets_any(lines: DataFrame, zones: DataFrame, line_id: str, ring: str = "ring", out: str = "in_zone") -> DataFrame:
    """Lines with a flag telling whether they meet at least one zone."""
    hits = segments_in_rings(lines.select(line_id, *SEG), zones.select(ring), line_id, ring).select(line_id).distinct()
    return lines.join(hits.withColumn(out, F.lit(True)), line_id, "left").withColumn(out, F.coalesce(out, F.lit(False)))


def bbox_scan(df: DataFrame, minx: float, miny: float, maxx: float, maxy: float, pad: float = 0.0) -> DataFrame:
    """Rows whose stored extent meets a padded box; plain comparisons that reach the Parquet reader."""
    return df.filter(
        (F.col("minx") <= maxx + pad) & (F.col("maxx") >= minx - pad)
        & (F.col("miny") <= maxy + pad) & (F.col("maxy") >= miny - pad)
    )


def with_bbox(df: DataFrame, seg: tuple = SEG) -> DataFrame:
    a, b, c, d = _seg_box(seg)
    return df.withColumns({"minx": a, "miny": b, "maxx": c, "maxy": d})
