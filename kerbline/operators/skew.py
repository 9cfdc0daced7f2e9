"""Splitting hot join keys.

Keys are hashed to a fixed number of buckets, rows are counted per bucket, and a bucket far above
the mean gets several salts. The salt table therefore has a fixed maximum size however many
distinct keys there are, and travels as one scalar value instead of a join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 65_536
MIN_ROWS = 200_000


def _bucket(keys: list[str]) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int")


def salts_for(df: DataFrame, keys: list[str], min_rows: int = MIN_ROWS, factor: int = 4) -> Column:
    """Number of salts of the current row's key, from the row counts of ``df``."""
    counts = df.groupBy(_bucket(keys).alias("b")).agg(F.count("*").alias("c"))
    table = counts.agg(
        F.collect_list(F.struct("b", "c")).alias("rows"), F.coalesce(F.sum("c"), F.lit(0)).alias("n")
    ).select(
        F.map_from_entries(
            F.filter(
                F.transform(
                    "rows",
                    lambda r: F.struct(
                        r.b.alias("b"),
                        F.ceil(r.c / F.greatest(F.lit(float(min_rows)), F.col("n") * factor / BUCKETS))
                        .cast("int")
                        .alias("s"),
                    ),
                ),
                lambda r: r.s > 1,
            )
        ).alias("salts")
    )
    return F.coalesce(F.element_at(table.scalar(), _bucket(keys)), F.lit(1))


def salt_pair(
    left: DataFrame, right: DataFrame, keys: list[str], spread_by: list[str], min_rows: int = MIN_ROWS
) -> tuple[DataFrame, DataFrame, list[str]]:
    """Add ``_salt`` so that the rows of a hot key on the left are spread over many tasks.

    Left rows take one salt by the hash of ``spread_by``; right rows are repeated once per salt
    of their key. Joining on ``keys + ['_salt']`` gives exactly the pairs of a join on ``keys``.
    """
    salts = salts_for(left, keys, min_rows)
    left = left.withColumn("_salt", F.pmod(F.xxhash64(*spread_by), salts.cast("long")).cast("int"))
    right = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    return left, right, keys + ["_salt"]


def salted_join(
    left: DataFrame, right: DataFrame, keys: list[str], spread_by: list[str], how: str = "inner",
    min_rows: int = MIN_ROWS,
) -> DataFrame:
    """Join (inner, left, left_semi or left_anti) that splits the hot keys of the left side."""
    l, r, on = salt_pair(left, right, keys, spread_by, min_rows)
    return l.join(r, on, how).drop("_salt")
