"""Delimited files in several encodings, gates, zones and enrollment."""

from __future__ import annotations

import csv
import io
import re
import sys

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from kerbline.functions.text import clean, fix_mojibake, to_number, zone_layer

# Encodings in the order they are tried.
ENCODINGS = ("utf-8-sig", "utf-8", "cp949", "euc-kr")
ROWS = StructType([
    StructField("path", StringType()), StructField("line", LongType()), StructField("cells", ArrayType(StringType())), StructField("reason", StringType())])
PART = 20_000  # rows handed over together


def decode_bytes(raw: bytes) -> str:
    """Text of the first encoding that reads the bytes."""
    for name in ENCODINGS:
        try:
            return raw.decode(name)
        except UnicodeDecodeError:
            continue
    raise ValueError("no known encoding fits")


def parse_file(raw: bytes, columns: list[str], required: list[str]):
    """(line, cells of ``columns``, reason) of a file's rows; a reason says why the row, or with line 0 the file, is rejected.

    Quoted cells may hold the separator, doubled quotes and line breaks. The header decides on the separator: a tab if
    it has one, else a comma. Lines count from 1, the header included. A row with fewer cells than the header ends in nulls.
    """
    try:
        text = decode_bytes(raw)
    except ValueError as problem:
        yield 0, None, str(problem)
        return
    first = re.split("\r\n|\r|\n", text, maxsplit=1)[0]
    csv.field_size_limit(sys.maxsize)
    reader = csv.reader(io.StringIO(text, newline=""), delimiter="\t" if "\t" in first else ",")
    header = [c.strip() for c in next(reader, [])]
    if lacking := [c for c in required if c not in header]:
        yield 0, None, "column missing: " + ", ".join(lacking)
        return
    at = [header.index(c) if c in header else None for c in columns]
    line = reader.line_num + 1
    for row in reader:
        if len(row) > len(header):
            yield line, row, "more cells than columns"
        elif len(row) > 1 or row and row[0].strip():
            yield line, [row[i] if i is not None and i < len(row) else None for i in at], None
        line = reader.line_num + 1


def scan_any_csv(spark: SparkSession, path: str, columns: list[str], required: list[str]) -> DataFrame:
    """Rows of CSV or TSV files of mixed encodings and dialects: path, line, cells and, for what is rejected, the reason.

    One task decodes one file (encodings cannot be told apart from the middle of a file). Large files of one
    encoding go through ``read_csv_encoded``, which splits.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def parsed(batches):
        for pdf in batches:
            for name, raw in zip(pdf["path"], pdf["content"], strict=True):
                part = []
                for row in parse_file(bytes(raw), columns, required):
                    part.append((name, *row))
                    if len(part) == PART:
                        yield pd.DataFrame(part, columns=ROWS.names)
                        part = []
                yield pd.DataFrame(part, columns=ROWS.names)

    return files.mapInPandas(parsed, ROWS)


def good_rows(scanned: DataFrame, columns: list[str]) -> DataFrame:
    """What is not rejected, as text columns plus ``file_name`` and ``path``."""
    return scanned.filter(F.col("reason").isNull()).select(
        F.regexp_extract("path", r"([^/]+)$", 1).alias("file_name"), "path", *[F.col("cells")[i].alias(c) for i, c in enumerate(columns)])


def rejects(scanned: DataFrame) -> DataFrame:
    """The quarantine table: rejected files (line 0) and rows, with their cells and the reason."""
    return scanned.filter(F.col("reason").isNotNull()).select("path", "line", "cells", "reason")


def read_any_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """CSV or TSV files of mixed encodings as text columns plus ``file_name``; a column that a file lacks is null.

    Rows and files that cannot be read are left out; ``scan_any_csv`` with ``rejects`` lists them.
    """
    return good_rows(scan_any_csv(spark, path, columns, []), columns).drop("path")


def read_csv_encoded(spark: SparkSession, path: str, schema: str, encoding: str = "UTF-8", sep: str = ",") -> DataFrame:
    """A splittable CSV read in a named encoding (cp949 needs ``spark.sql.legacy.javaCharsets``)."""
    if encoding.lower() not in ("utf-8", "us-ascii", "iso-8859-1", "utf-16"):
        spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    return spark.read.csv(path, schema=schema, header=True, encoding=encoding, sep=sep, mode="PERMISSIVE")


def write_csv_dual(df: DataFrame, path: str, name: str) -> None:
    """Two copies: UTF-8 and cp949 (characters without a code become '?')."""
    spark = df.sparkSession
    spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    spark.conf.set("spark.sql.legacy.codingErrorAction", "true")
    df.write.mode("overwrite").csv(f"{path}/{name}_utf8", header=True, encoding="UTF-8")
    df.write.mode("overwrite").csv(f"{path}/{name}_cp949", header=True, encoding="cp949")


def split_by_kind(rows: DataFrame, kind: str) -> dict[str, DataFrame]:
    """NODE and LINK rows of one mixed file as two filters over the same scan."""
    return {k: rows.filter(F.col(kind) == k) for k in ("NODE", "LINK")}


def normalise_gates(raw: DataFrame, default_type: str) -> DataFrame:
    """Clean names, default gate type, numeric coordinates, validity."""
    lon, lat = to_number("lon"), to_number("lat")
    return raw.withColumns({
        "school_name": clean("school_name"), "gate_type": F.coalesce(clean("gate_type"), F.lit(default_type)), "lon": lon, "lat": lat,
    }).withColumn(
        "valid", F.col("school_name").isNotNull() & F.coalesce((F.col("lon") != 0) & (F.col("lat") != 0), F.lit(False))
    )


def normalise_zones(raw: DataFrame, city_code: str) -> DataFrame:
    """Zones of one city with repaired names and their storage layer."""
    kept = raw.filter(F.col("city_code").cast("string") == city_code)
    return kept.withColumn("zone_name", fix_mojibake("zone_name")).withColumn("layer", zone_layer("zone_name"))


def load_enrollment(rows: DataFrame, name: str, total: str, order: str) -> DataFrame:
    """School to student count: unreadable counts are skipped, the last row of a name wins."""
    df = rows.select(clean(name).alias("school"), F.col(total).try_cast("bigint").alias("total"), F.col(order).alias("_o")).filter(
        F.col("school").isNotNull() & F.col("total").isNotNull()
    )
    return df.groupBy("school").agg(F.max_by("total", "_o").alias("total"))
