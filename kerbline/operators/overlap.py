"""Length of one polyline within a distance of another."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbline.functions import geometry as G


def lines_overlap(pairs: DataFrame, a_id: str, b_id: str, a: str, b: str, radius: float) -> DataFrame:
    """Per pair: metres of line ``a`` within ``radius`` of line ``b``, as ``overlap_m``.

    Every segment of ``a`` is clipped by every segment of ``b`` near it to one interval; overlapping
    intervals of a segment are merged before their lengths are added.
    """
    left = pairs.select(a_id, b_id, F.posexplode(G.edges_of(F.col(a))).alias("_i", "_a"), F.col(b).alias("_other"))
    cut = left.select(a_id, b_id, "_i", "_a", F.explode(G.edges_of(F.col("_other"))).alias("_b"))
    seg_a, seg_b = (tuple(f"_{s}.{c}" for c in ("x1", "y1", "x2", "y2")) for s in "ab")
    spans = cut.select(a_id, b_id, "_i", G.distance(*seg_a).alias("_l"), G.capsule_interval(seg_a, seg_b, radius).alias("_s"))
    merged = spans.groupBy(a_id, b_id, "_i").agg(
        F.first("_l").alias("_l"), F.array_sort(F.collect_list(F.when(F.col("_s.lo").isNotNull(), F.col("_s")))).alias("_spans")
    )
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(-1.0).alias("end"))
    covered = F.aggregate(
        "_spans", start,
        lambda acc, s: F.struct(
            (acc.sum + F.greatest(s.hi - F.greatest(s.lo, acc.end), F.lit(0.0))).alias("sum"), F.greatest(acc.end, s.hi).alias("end")
        ),
        lambda acc: acc.sum,
    )
    return merged.groupBy(a_id, b_id).agg(F.sum(covered * F.col("_l")).alias("overlap_m"))
