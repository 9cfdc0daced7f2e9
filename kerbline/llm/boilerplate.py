"""Lines that are spread over many sites, and documents without them.

A line counts as boilerplate when it occurs on at least ``min_sites`` distinct sites. Lines are named by
two 64-bit hashes, the second with a seed of its own (the salt goes first: hashed last it would only hash the
first hash again). A line on one site only cannot qualify and is set aside by comparing the smallest and
the largest site hash. For the rest a HyperLogLog sketch of the sites is built per line; sketches merge in
the aggregation, so a line with any number of occurrences travels as one sketch per partition. Estimates
clearly above or below the threshold decide; lines within ``BAND`` standard errors of it get an exact
distinct count.

Lines are compared without blanks, tabs and carriage returns at their ends; empty lines never count. A null
text is an empty text, a null site is a site of its own. Rows are told apart by id and text; rows equal
in both lose the same lines. With ``min_sites`` of 1 every line is boilerplate.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import LongType, StringType, StructType

from kerbline.llm.texts import row_key
from kerbline.session import materialise

MIN_SITES = 8
LG_REGISTERS = 10
BAND = 5  # standard errors
LINE = ["h1", "h2"]


def lines_of(df: DataFrame, doc_id: str, text: str, site: str) -> DataFrame:
    """(id, key, pos, h1, h2, site) for every non-empty line."""
    split = F.split(F.coalesce(F.col(text), F.lit("")), "\n")
    rows = df.select(
        F.col(doc_id).alias("id"), row_key(F.col(doc_id), F.col(text)).alias("key"),
        F.when(F.col(site).isNull(), F.xxhash64(F.lit("no site"), F.lit(1))).otherwise(F.xxhash64(F.col(site))).alias("site"), F.posexplode(split).alias("pos", "line"))
    trimmed = F.btrim("line", F.lit(" \t\r"))
    return rows.filter(trimmed != "").select("id", "key", "pos", F.xxhash64(trimmed).alias("h1"), F.xxhash64(F.lit(1), trimmed).alias("h2"), "site")


def spread_lines(lines: DataFrame, min_sites: int) -> tuple[DataFrame, DataFrame]:
    """The lines on several sites (materialised), and the hashes of those on at least ``min_sites``."""
    if min_sites <= 1:
        return lines, lines.select(*LINE).distinct()
    several = lines.groupBy(*LINE).agg(F.min("site").alias("a"), F.max("site").alias("b")).filter("a <> b").select(*LINE)
    shared = materialise(lines.join(several, LINE, "left_semi"), "lines")
    sketches = shared.groupBy(*LINE).agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", LG_REGISTERS)).alias("sites"))
    width = BAND * 1.04 / 2 ** (LG_REGISTERS / 2)
    judged = materialise(sketches.filter(F.col("sites") >= min_sites * (1 - width)), "spread")
    clear = F.col("sites") > min_sites * (1 + width)
    near = shared.join(judged.filter(~clear).select(*LINE), LINE, "left_semi").select(*LINE, "site").distinct()
    exact = near.groupBy(*LINE).agg(F.count("*").alias("n")).filter(F.col("n") >= min_sites)
    return shared, judged.filter(clear).select(*LINE).union(exact.select(*LINE))


@pandas_udf(StructType().add("kept", StringType()).add("n_lines", LongType()).add("n_removed", LongType()))
def _without(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for texts, places in batches:
        out = []
        for text, gone in zip(texts, places, strict=True):
            lines = (text or "").split("\n")
            gone = set() if gone is None else set(gone)
            out.append(("\n".join(x for i, x in enumerate(lines) if i not in gone) if gone else text or "", len(lines), len(gone)))
        yield pd.DataFrame(out, columns=["kept", "n_lines", "n_removed"])


def remove_boilerplate(df: DataFrame, doc_id: str = "doc_id", text: str = "text", site: str = "source", min_sites: int = MIN_SITES, into: str = "without") -> DataFrame:
    """``df`` with a struct (kept, n_lines, n_removed): its text without the lines spread over many sites."""
    shared, spread = spread_lines(lines_of(df, doc_id, text, site), min_sites)
    found = shared.join(spread, LINE, "left_semi").select("id", "key", "pos").distinct()
    gone = found.groupBy("id", "key").agg(F.collect_list("pos").alias("_gone")).withColumnsRenamed({"id": "_g_id", "key": "_g_key"})
    own = df.withColumn("_key", row_key(F.col(doc_id), F.col(text)))
    joined = own.join(gone, own[doc_id].eqNullSafe(gone["_g_id"]) & (own["_key"] == gone["_g_key"]), "left")
    return joined.withColumn(into, _without(F.col(text), F.col("_gone"))).select(*df.columns, into)
