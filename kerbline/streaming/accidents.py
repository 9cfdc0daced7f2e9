"""Accident files as they arrive: each accident once, counted on its nearest link."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbline.operators.spatial import nearest
from kerbline.session import cut_lineage


def deduplicated(stream: DataFrame, delay: str = "1 day") -> DataFrame:
    """Each accident id once within the watermark delay."""
    return stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["acdnt_no"])


def counts_per_link(batch: DataFrame, links: DataFrame, radius: float) -> DataFrame:
    """Links of one micro-batch: the nearest link of every accident at any distance, counted (for ``foreachBatch``).

    ``radius``: where the search starts; it doubles for the accidents that have no link within it.
    """
    best = nearest(batch, links, "acdnt_no", "link_id", radius)
    return best.groupBy("link_id").agg(F.count("*").alias("n"))


def ingest(stream: DataFrame, links: DataFrame, radius: float, table: str, checkpoint: str, delay: str = "1 day"):
    """Start the stream: partial counts per micro-batch land under ``table``, one folder per batch.

    A repeated batch after a failure overwrites its own folder, so every accident counts once.
    """

    def land(batch: DataFrame, number: int) -> None:
        batch = cut_lineage(batch)
        if not batch.isEmpty():
            counts_per_link(batch, links, radius).write.mode("overwrite").parquet(f"{table}/batch={number}")

    return deduplicated(stream, delay).writeStream.foreachBatch(land).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_counts(spark, table: str) -> DataFrame:
    return spark.read.parquet(table).groupBy("link_id").agg(F.sum("n").alias("accidents"))
