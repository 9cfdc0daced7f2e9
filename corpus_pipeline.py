"""A corpus pipeline of the text operators; every stage's decisions take effect on what its predecessor kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbline.llm import bpe, decontaminate, exact, langid, shingles
from kerbline.llm.texts import documents, held_out
from kerbline.session import materialise

BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def _bounded_batches(spark: SparkSession) -> None:
    """Whole documents go to Python in batches of a few megabytes, unless the session was given a bound of its own.

    With Spark's own bound (64 MB) the buffers of both sides would grow with the length of the texts.
    """
    if spark.conf.get(BATCH) == "67108864b":  # what Spark sets by itself
        spark.conf.set(BATCH, "4m")


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is clear; texts without letters and narrow margins go."""
    _bounded_batches(spark)
    known = langid.learn(docs.filter(~held_out(F.col("doc_id"))), "text", "lang")
    return langid.identify(docs, "text", known, into="_language").filter(~F.col("_language.rejected")).select(*docs.columns)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id."""
    _bounded_batches(spark)
    return exact.drop_duplicates(docs, keep="max")


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8 or more) the row with the smallest doc_id."""
    _bounded_batches(spark)
    return shingles.drop_near_copies(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    _bounded_batches(spark)
    return decontaminate.without_passages(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), short=True)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of what is left: tokens, and the text decoded from them."""
    _bounded_batches(spark)
    tokenizer = bpe.Source(spark, public_tokenizers.path("byte_bpe_50k.json"))
    both = bpe.encode(docs.select("doc_id", "text"), "text", tokenizer, "ids", back="decoded")
    return both.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("language_id", language_stage), ("exact_dedup", exact_stage), ("simhash_near_dedup", near_stage), ("benchmark_decontamination", benchmark_stage),
    ("bpe", token_stage),
]
#: SQL has neither zstandard nor byte-pair encoding; tests/llm/test_pipeline.py holds the rows against a plain program.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each result is written as Parquet and read again as the next one's input."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


def pipeline_queries() -> dict:
    return {"pipeline": run}
