"""Queries ``opN_<name>``: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbline.llm import alignment, boilerplate, bpe, decontaminate, divergence, exact, langid, passages, pii, reputation, simhash, substrings, toxicity
from kerbline.llm.texts import documents, held_out

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return register


def language_dictionaries(docs: DataFrame) -> dict[str, bytes]:
    return langid.learn(docs.filter(~held_out(F.col("doc_id"))), "text", "lang")


@query("op3_language_id")
def language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder).select("doc_id", "text", "lang")
    found = langid.identify(docs.select("doc_id", "text"), "text", language_dictionaries(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "language.lang_pred", "language.score", "language.rejected")


@query("op4_toxicity")
def toxic(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder).select("doc_id", "text")
    labels = spark.read.parquet(f"{folder}/labels.parquet").filter(~held_out(F.col("doc_id")))
    model = toxicity.learn(docs.filter(~held_out(F.col("doc_id"))), labels)
    scored = docs.withColumn("score", toxicity.scorer(model)("text"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@query("op5_bpe")
def byte_pairs(spark: SparkSession, folder: str) -> DataFrame:
    tokenizer = bpe.Source(spark, public_tokenizers.path("byte_bpe_50k.json"))
    both = bpe.encode(documents(spark, folder).select("doc_id", "text"), "text", tokenizer, "ids", back="decoded")
    return both.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op7_exact_dedup", """
    with d as (select doc_id, sha256(coalesce(text, '')) as text_sha256 from documents)
    select doc_id, max(doc_id) over g as keep_id, count(*) over g as group_size, doc_id = max(doc_id) over g as kept, text_sha256
    from d window g as (partition by text_sha256)""")
def exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = exact.exact_duplicates(documents(spark, folder), keep="max")
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


@query("op8_simhash")
def simhash_groups(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, folder))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


@query("op9_line_dedup", """
    with l as (
        select doc_id, coalesce('s' || source, '') as site, i, parts[i] as line, trim(parts[i], ' ' || chr(9) || chr(13)) as bare
        from (select doc_id, source, parts, unnest(range(1, len(parts) + 1)) as i from (select doc_id, source, string_split(coalesce(text, ''), chr(10)) as parts from documents))),
    spread as (select bare from l where bare <> '' group by bare having count(distinct site) >= 8),
    marked as (select l.*, s.bare is not null as gone from l left join spread s using (bare))
    select doc_id, count(*) as n_lines, count(*) filter (gone) as n_removed,
        sha256(coalesce(string_agg(line, chr(10) order by i) filter (not gone), '')) as kept_sha256
    from marked group by doc_id""")
def line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = boilerplate.remove_boilerplate(documents(spark, folder).select("doc_id", "text", "source"))
    return found.select("doc_id", "without.n_lines", "without.n_removed", F.sha2("without.kept", 256).alias("kept_sha256"))


@query("op10_decontamination")
def decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.find_passages(documents(spark, folder), spark.read.parquet(f"{folder}/benchmark.parquet"), short=True, every=True)


@query("op2_pii")
def private(spark: SparkSession, folder: str) -> DataFrame:
    found = pii.private_spans(documents(spark, folder))
    of = lambda k: F.size(F.filter("base", lambda s: s.kind == k)).cast("long")
    kinds = F.array(*[F.lit(k) for k in pii.KINDS])
    base = F.array_join(F.transform("base", lambda s: F.concat_ws(":", F.element_at(kinds, s.kind + 1), s.start, s.end)), ",")
    return found.select(
        F.col("id").alias("doc_id"), of(0).alias("n_email"), of(1).alias("n_ip"), of(2).alias("n_card"), of(3).alias("n_phone"), F.sha2(base, 256).alias("base_sha256"), "spans")


@query("op6_substring_dedup")
def word_passages(spark: SparkSession, folder: str) -> DataFrame:
    found = substrings.repeated_passages(documents(spark, folder))
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_removed", "kept_sha256")


@query("op1_suffix_dedup")
def byte_passages(spark: SparkSession, folder: str) -> DataFrame:
    found = passages.remove_repeats(documents(spark, folder))
    return found.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")


@query("op11_divergence", divergence.AUDIT_SQL)
def source_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return divergence.audit(documents(spark, folder))


@query("op12_url_filter", reputation.JUDGE_SQL)
def url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return reputation.judge(spark.read.parquet(f"{folder}/pages.parquet"))


@query("op13_alignment")
def tokenizer_alignment(spark: SparkSession, folder: str) -> DataFrame:
    pair = alignment.Pair(spark, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    return alignment.align(documents(spark, folder), pair)
