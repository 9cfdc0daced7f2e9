"""One storage layer per school zone, and slimmed layers for export."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbline.functions.geometry import round_coords
from kerbline.functions.simplify import simplify_line


def write_layers(df: DataFrame, path: str, layer: str = "zone_layer", skip_existing: bool = True) -> None:
    """Write layers as partitions. Existing layers are left alone, or replaced one by one."""
    spark = df.sparkSession
    if skip_existing:
        try:
            old = spark.read.parquet(path).select(layer).distinct()
        except Exception as exc:  # noqa: BLE001 - the first write has nothing to read
            if "PATH_NOT_FOUND" not in str(exc):
                raise
        else:
            df = df.join(old, layer, "left_anti")
        df.write.mode("append").partitionBy(layer).parquet(path)
    else:
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(layer).parquet(path)


def read_layer(spark: SparkSession, path: str, name: str, layer: str = "zone_layer") -> DataFrame:
    """One layer, by partition pruning."""
    return spark.read.parquet(path).filter(F.col(layer) == name)


def slim(df: DataFrame, keep: list[str], geom: str, tolerance: float, digits: int = 5) -> DataFrame:
    """Keep-list of properties, simplified and rounded geometry, point counts before and after."""
    small = df.select(*keep, F.size(geom).alias("points_before"), simplify_line(F.col(geom), F.lit(float(tolerance))).alias(geom))
    return small.withColumn("points_after", F.size(geom)).withColumn(geom, round_coords(geom, digits))


def slim_report(slimmed: DataFrame) -> DataFrame:
    one = slimmed.agg(F.sum("points_before").alias("points_before"), F.sum("points_after").alias("points_after"))
    return one.withColumn("shrink_pct", F.try_divide(F.col("points_before") - F.col("points_after"), F.col("points_before")) * 100)
