"""JSON and GeoJSON inputs and outputs."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Places where record lists are found in service responses, in the order they are tried.
RECORD_PATHS = [
    "$.resultValue.accidentInfoList", "$.accidentInfoList", "$.result.items", "$.items", "$.data", "$.response.body.items.item",
]
ITEM_PATH = "$.response.body.items.item"
FEATURE_TYPES = ["Point", "LineString", "MultiLineString", "Polygon", "MultiPolygon", "GeometryCollection"]


def first_records(df: DataFrame, text: str, element: str, paths: list[str] = RECORD_PATHS) -> DataFrame:
    """Rows of the first path of a JSON document that holds a list of objects; documents without one give none.

    ``element`` is the struct type of a record.
    """
    doc = F.try_parse_json(F.col(text))
    found = F.coalesce(*[F.try_variant_get(doc, p, f"array<{element}>") for p in paths])
    rest = [c for c in df.columns if c != text]
    return df.select(*rest, F.explode(found).alias("_r")).select(*rest, "_r.*")


def item_or_list(df: DataFrame, text: str, element: str, path: str = ITEM_PATH) -> DataFrame:
    """Records at ``path``, which holds one object or a list of them; malformed documents give none."""
    doc = F.try_parse_json(F.col(text))
    many = F.try_variant_get(doc, path, f"array<{element}>")
    one = F.try_variant_get(doc, path, element)
    rest = [c for c in df.columns if c != text]
    items = F.coalesce(many, F.when(one.isNotNull(), F.array(one)))
    return df.select(*rest, F.explode(items).alias("_r")).select(*rest, "_r.*")


def read_json_batches(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Response files of one folder as a record set, tagged with their file name."""
    return spark.read.schema(schema).json(path).withColumn("file_name", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)$", 1))


def to_feature(geometry: Column, properties: list[str], id_column: str | None = None) -> Column:
    """GeoJSON Feature text. ``geometry`` is a struct (type, coordinates) or null."""
    parts = [F.lit("Feature").alias("type")]
    if id_column:
        parts.append(F.col(id_column).cast("string").alias("id"))
    parts += [geometry.alias("geometry"), F.struct(*properties).alias("properties")]
    return F.to_json(F.struct(*parts), {"ignoreNullFields": "false"})


def line_geometry(geom) -> Column:
    geom = F.col(geom) if isinstance(geom, str) else geom
    return F.struct(F.lit("LineString").alias("type"), F.transform(geom, lambda p: F.array(p.x, p.y)).alias("coordinates"))


def point_geometry(x, y) -> Column:
    return F.struct(F.lit("Point").alias("type"), F.array(F.col(x), F.col(y)).alias("coordinates"))


def write_features(features: DataFrame, path: str) -> None:
    """One Feature per line (GeoJSON sequence), one file per partition."""
    features.select("value").write.mode("overwrite").text(path)


def write_collections(features: DataFrame, path: str, metadata: dict | None = None, files: int | None = None) -> None:
    """One FeatureCollection document per file, one file per partition (``files`` of them if stated).

    ``features`` has Feature texts in ``value``; nulls are left out. Every document ends with ``metadata``: what is
    given, and ``feature_count``, the number of its features. Documents are streamed line by line, so no task holds one,
    and files come into being by Spark's own commit of tasks: a task that fails or runs twice leaves one copy.
    The first partition always makes a document, so an empty table gives one without features.
    """
    fixed = dict(metadata or {})

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead, n = '{"type":"FeatureCollection","features":[', 0
        for b in batches:
            texts = b.column(0).drop_null()
            if len(texts):
                leads = pa.array([lead] + [","] * (len(texts) - 1), texts.type)
                yield pa.record_batch([pc.binary_join_element_wise(leads, texts, pa.scalar("", texts.type))], ["value"])
                lead, n = ",", n + len(texts)
        if n or TaskContext.get().partitionId() == 0:
            end = json.dumps({**fixed, "feature_count": n}, ensure_ascii=False)
            yield pa.record_batch([pa.array([("" if n else lead) + f'],"metadata":{end}}}'])], ["value"])

    # An empty row in a partition of its own, so that a table without partitions is written as well.
    rows = features.select("value").union(features.sparkSession.range(0, 1, 1, 1).select(F.lit(None).cast("string")))
    if files is not None:
        rows = rows.repartition(files)
    rows.mapInArrow(documents, "value string").write.mode("overwrite").option("maxRecordsPerFile", 0).text(path)


def read_feature_lines(spark: SparkSession, path: str, properties: str, coordinates: str = "array<array<double>>") -> DataFrame:
    """Features written one per line; splits like any text file."""
    schema = f"type string, id string, geometry struct<type:string,coordinates:{coordinates}>, properties struct<{properties}>"
    return spark.read.schema(schema).json(path)


def read_feature_collection(spark: SparkSession, path: str, properties: str, coordinates: str = "array<array<double>>") -> DataFrame:
    """Features of whole FeatureCollection documents (one document per file); a file is read by one task."""
    schema = f"type string, features array<struct<type:string,id:string,geometry:struct<type:string,coordinates:{coordinates}>,properties:struct<{properties}>>>"
    return spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("features").alias("f")).select("f.*")


def read_collection_counts(spark: SparkSession, path: str) -> DataFrame:
    """(file, features) as the metadata of written collections state them."""
    meta = spark.read.schema("metadata struct<feature_count:bigint>").option("multiLine", True).json(path)
    return meta.select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)$", 1).alias("file"), F.col("metadata.feature_count").alias("features"))


def validate_features(df: DataFrame, text: str, null_geometry: bool = True) -> DataFrame:
    """Add ``valid`` and ``reason`` to rows of Feature text."""
    parsed = F.from_json(F.col(text), "type string, geometry struct<type:string,coordinates:string>, properties string")
    missing = parsed.getField("geometry").isNull()
    reason = (
        F.when(parsed.isNull() | parsed.getField("type").isNull() | (parsed.getField("type") != "Feature"), "type")
        .when(missing & F.lit(not null_geometry), "geometry_missing")
        .when(~missing & (parsed.getField("geometry").getField("type").isNull()
                          | ~parsed.getField("geometry").getField("type").isin(*FEATURE_TYPES)), "geometry_type")
        .when(~missing & parsed.getField("geometry").getField("coordinates").isNull(), "coordinates")
    )
    return df.withColumn("reason", reason).withColumn("valid", F.col("reason").isNull())


def bbox_warnings(df: DataFrame, name: str, x: str, y: str, box: tuple[float, float, float, float] = (124.0, 33.0, 132.0, 39.0)) -> DataFrame:
    """One row: coordinates outside the box, and rows whose name already occurred."""
    inside = F.col(x).between(box[0], box[2]) & F.col(y).between(box[1], box[3])
    per = df.groupBy(name).agg(F.count("*").alias("c"), F.count_if(~F.coalesce(inside, F.lit(False))).alias("o"))
    return per.agg(F.sum("o").alias("outside"), F.sum(F.col("c") - 1).alias("duplicate_names"))


def summary_json(df: DataFrame, aggregates: list[Column]) -> DataFrame:
    """One row with the aggregates as a JSON object, ``summary``."""
    one = df.agg(*aggregates)
    return one.select(F.to_json(F.struct(*one.columns)).alias("summary"))
