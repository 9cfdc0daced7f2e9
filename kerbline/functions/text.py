"""Text clean-up, casts and JSON helpers as column expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def _c(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def to_number(x) -> Column:
    """Text to double; anything unreadable, NaN or blank becomes null."""
    v = F.trim(_c(x)).try_cast("double")
    return F.when(~F.isnan(v), v)


def nan_to_null(x) -> Column:
    x = _c(x)
    return F.when(~(F.isnan(x) | (F.abs(x) == float("inf"))), x)


def finite_columns(df: DataFrame) -> DataFrame:
    """NaN and infinities to null in every double column and double array, before writing JSON."""
    changes = {}
    for name, kind in df.dtypes:
        if kind in ("double", "float"):
            changes[name] = nan_to_null(name)
        elif kind in ("array<double>", "array<float>"):
            changes[name] = F.transform(name, nan_to_null)
    return df.withColumns(changes) if changes else df


def to_id(x) -> Column:
    """Ids stored as '89702.0' to integers."""
    return _c(x).try_cast("double").try_cast("bigint")


def zero_pad(x, width: int = 4, missing: str = "NA") -> Column:
    """Numeric code to fixed-width text."""
    n = _c(x).try_cast("double").try_cast("bigint").cast("string")
    return F.coalesce(F.lpad(n, F.greatest(F.lit(width), F.length(n)), F.lit("0")), F.lit(missing))


def clean(x) -> Column:
    """Trimmed text; blank and 'nan' are null."""
    s = F.trim(_c(x))
    return F.when((s != "") & (F.lower(s) != "nan"), s)


@F.pandas_udf(StringType())
def fix_mojibake(texts: pd.Series) -> pd.Series:
    """Undo cp1252 decoding of euc-kr bytes; unchanged where that is not what happened."""

    def repair(s):
        try:
            return s.encode("cp1252").decode("euc-kr")
        except (UnicodeEncodeError, UnicodeDecodeError, AttributeError):
            return s

    return texts.map(repair)


# Endings and shapes of school-zone and address texts, as the given data spell them.


def zone_layer(x) -> Column:
    """School-zone name to the name of its storage layer."""
    name = F.regexp_replace(F.regexp_replace(_c(x), "공동통학구역$", ""), "통학구역$", "")
    school = F.regexp_extract(name, r"서울\S+초|[가-힣]+초", 0)
    name = F.when(school != "", school).otherwise(name)
    name = F.regexp_replace(F.regexp_replace(name, "^서울", ""), r"[^\p{L}\p{N}_]", "")
    return F.when(name != "", F.concat(name, F.lit("_res"))).otherwise(F.lit("unknown_res"))


def school_short(x) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(_c(x)), "^서울", ""), "등학교$", ""))


def layer_short(x) -> Column:
    return F.trim(F.replace(_c(x), F.lit("_res"), F.lit("")))


def zone_school(x) -> Column:
    """'X초통학구역' to 'X초등학교'; other names give null."""
    x = _c(x)
    return F.when(x.endswith("초통학구역"), F.concat(F.regexp_replace(x, "통학구역$", ""), F.lit("등학교")))


def clean_address(x, city: str = "서울", full: str = "서울특별시", district: str = "관악구") -> Column:
    """City written in full, district names prefixed with it, brackets dropped, blanks squeezed."""
    s = F.replace(_c(x), F.lit(city + "시"), F.lit(full))
    s = F.replace(s, F.lit(city + " "), F.lit(full + " "))
    s = F.when(s.startswith(district), F.concat(F.lit(full + " "), s)).otherwise(s)
    return F.trim(F.regexp_replace(F.regexp_replace(s, r"\([^)]*\)", ""), r"\s+", " "))


def address_variants(x, city: str = "서울", district: str = "관악구") -> Column:
    """Distinct spellings to try: as given, without building and unit, with the district in front."""
    q = F.regexp_replace(F.trim(_c(x)), r"\s+", " ")
    bare = F.trim(
        F.regexp_replace(F.regexp_replace(q, r"\s+\d{1,4}\s*동(\s+\d{1,4}\s*호)?$", ""), r"\s+\d{1,4}\s*동.*$", "")
    )
    prefixed = F.when(~(q.startswith(city) | q.startswith(district)), F.concat(F.lit(f"{city} {district} "), q))
    return F.array_distinct(F.filter(F.array(q, bare, prefixed), lambda v: v.isNotNull() & (v != "")))


def split_tags(x) -> Column:
    return F.filter(F.split(_c(x), ","), lambda t: t != "")


def join_tags(x) -> Column:
    return F.array_join(_c(x), ",")


MEASURE_SCHEMA = "array<struct<measure:string,effect_reduction:double,source:string,cost:double,CE:double>>"


def parse_measures(x) -> Column:
    return F.from_json(_c(x), MEASURE_SCHEMA)


def first_matching_column(columns: list[str], exact: list[str], parts: list[str]) -> str | None:
    """A column by exact name, else the first whose name contains one of ``parts``."""
    for name in exact:
        if name in columns:
            return name
    return next((c for c in columns if any(p in c for p in parts)), None)


def first_column_containing(df: DataFrame, columns: list[str], needles: list[str]) -> str | None:
    """The first column with a value that contains one of ``needles`` (one aggregate pass)."""
    tests = []
    for c in columns:
        hit = F.lit(False)
        for n in needles:
            hit = hit | F.coalesce(F.col(c).cast("string").contains(n), F.lit(False))
        tests.append(F.max(hit).alias(c))
    row = df.agg(*tests).first()
    return next((c for c in columns if row[c]), None)


# --- WKT --------------------------------------------------------------------------------------------

_NUM = r"-?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?"


def parse_wkt_point(x) -> Column:
    """'POINT(x y)' to a point struct; null for anything else."""
    pat = rf"^\s*POINT\s*\(\s*({_NUM})\s+({_NUM})\s*\)\s*$"
    px, py = F.regexp_extract(_c(x), pat, 1), F.regexp_extract(_c(x), pat, 2)
    return F.when(px != "", F.struct(px.try_cast("double").alias("x"), py.try_cast("double").alias("y")))


def parse_wkt_line(x) -> Column:
    """'LINESTRING(x y, …)' with at least two vertices to an array of points; null for anything else."""
    pat = rf"^\s*LINESTRING\s*\(\s*({_NUM}\s+{_NUM}(?:\s*,\s*{_NUM}\s+{_NUM})+)\s*\)\s*$"
    body = F.regexp_extract(_c(x), pat, 1)
    pts = F.transform(
        F.split(body, r"\s*,\s*"),
        lambda p: F.struct(
            F.try_element_at(F.split(F.trim(p), r"\s+"), F.lit(1)).try_cast("double").alias("x"),
            F.try_element_at(F.split(F.trim(p), r"\s+"), F.lit(2)).try_cast("double").alias("y"),
        ),
    )
    return F.when(body != "", pts)


def parse_wkt_polygon(x) -> Column:
    """'POLYGON((…),(…))' to an array of open rings."""
    body = F.regexp_extract(_c(x), r"^\s*POLYGON\s*\(\s*\((.*)\)\s*\)\s*$", 1)
    rings = F.transform(
        F.split(body, r"\)\s*,\s*\("),
        lambda ring: F.transform(
            F.split(ring, r"\s*,\s*"),
            lambda p: F.struct(
                F.try_element_at(F.split(F.trim(p), r"\s+"), F.lit(1)).try_cast("double").alias("x"),
                F.try_element_at(F.split(F.trim(p), r"\s+"), F.lit(2)).try_cast("double").alias("y"),
            ),
        ),
    )
    opened = F.transform(
        rings,
        lambda r: F.when(
            (F.size(r) > 1) & (F.element_at(r, 1) == F.element_at(r, -1)), F.slice(r, F.lit(1), F.size(r) - 1)
        ).otherwise(r),
    )
    return F.when(body != "", opened)


def to_wkt_line(geom) -> Column:
    """Array of points to 'LINESTRING(…)'."""
    return F.concat(
        F.lit("LINESTRING("),
        F.array_join(F.transform(_c(geom), lambda p: F.concat_ws(" ", p.x.cast("string"), p.y.cast("string"))), ", "),
        F.lit(")"),
    )


@F.pandas_udf(StringType())
def garble(texts: pd.Series) -> pd.Series:
    """euc-kr bytes read as cp1252, where every byte has such a reading (the fault ``fix_mojibake`` undoes)."""

    def spoil(s):
        try:
            return s.encode("euc-kr").decode("cp1252")
        except (UnicodeEncodeError, UnicodeDecodeError, AttributeError):
            return s

    return texts.map(spoil)
