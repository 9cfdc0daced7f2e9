"""Connected components of an edge table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbline.session import drop_table, materialise


def _state(edges: DataFrame) -> tuple[int, int]:
    r = edges.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0)).alias("h")).first()
    return r["n"], int(r["h"])


def components(edges: DataFrame) -> DataFrame:
    """(v, root): every vertex of ``edges`` (a, b: long) with the smallest vertex of its component.

    Each round links every vertex's larger neighbours, then its smaller ones, to the smallest vertex it
    knows; the number of edges never grows, and after a number of rounds logarithmic in the longest
    path every vertex has one edge, to its root. Per vertex only a minimum is aggregated. The rows of a
    hub meet a single row in the joins, so adaptive execution can split them. Only a row count and
    a checksum come to the driver, and each round's edges are written to the shared folder.
    """
    spark = edges.sparkSession
    now = materialise(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    state = _state(now)
    while state[0]:
        both = now.union(now.select("v", "u").toDF("u", "v"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        linked = large.join(small, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = materialise(linked.union(small.select("u", F.col("m").alias("v"))).distinct(), "edges")
        drop_table(spark, now)
        now, before, state = after, state, _state(after)
        if state == before:
            break
    return now.select(F.col("u").alias("v"), F.col("v").alias("root")).union(now.select(F.col("v"), F.col("v").alias("root")).distinct())
