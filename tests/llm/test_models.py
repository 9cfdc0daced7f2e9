"""Language identification and toxicity: held-out quality, odd input, the learning rules."""

import duckdb
import numpy as np
from pyspark.sql import functions as F

from kerbline.llm import langid, toxicity
from kerbline.llm.catalog import QUERIES

FOLDER = "/root/testdata/sf0.01"


def test_language_held_out(spark):
    truth = dict(duckdb.sql(f"select doc_id, lang from '{FOLDER}/documents.parquet'").fetchall())
    got = [r for r in QUERIES["op3_language_id"](spark, FOLDER).collect() if r["held_out"]]
    assert len(got) > 250
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in got) / len(got) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got)
    assert sum(r["rejected"] for r in got) < 0.03 * len(got)


def test_language_odd_rows(odd, none, small):
    known = langid.learn(small, "text", "lang")
    got = langid.identify(odd, "text", known)
    assert got.columns == [*odd.columns, "language"]
    for r in got.collect():
        has_letter = any(c.isalpha() for c in r["text"] or "")
        assert (r["language"]["lang_pred"] == "und") == (not has_letter)
        assert has_letter or (r["language"]["rejected"] and r["language"]["score"] == 0)
    assert langid.identify(none, "text", known).count() == 0
    assert langid.learn(none, "text", "lang") == {}
    assert {r["language"]["lang_pred"] for r in langid.identify(odd, "text", {}).collect()} == {"und"}


def test_narrow_margins_are_rejected():
    c = langid.Compressors({"aa": b"the cat sat on the mat " * 50, "bb": b"the cat sat on the mat " * 50})
    assert c.predict("the cat sat on the mat", 0.01) == ("aa", 0.0, True)


def test_language_sample_is_bounded(spark):
    df = spark.range(5000).selectExpr("concat('some words ', id) as text", "'en' as lang")
    assert len(langid.learn(df, "text", "lang", sample=20, piece=10)["en"]) <= 20 * 11


def test_toxicity_held_out(spark):
    folder = "/root/testdata/sf0.1"
    truth = dict(duckdb.sql(f"select doc_id, toxic from '{folder}/labels.parquet'").fetchall())
    got = [r for r in QUERIES["op4_toxicity"](spark, folder).collect() if r["held_out"] and r["doc_id"] in truth]
    toxic = [r for r in got if truth[r["doc_id"]] == 1]
    clean = [r for r in got if truth[r["doc_id"]] == 0]
    assert sum(r["predicted"] for r in toxic) / len(toxic) > 0.85
    assert sum(r["predicted"] for r in clean) / len(clean) < 0.03


def test_risk_stays_non_negative():
    """With far more features than rows an unbiased estimator falls below zero; the fitted risk may not by much."""
    rng = np.random.default_rng(0)
    p, u = (rng.random((20, 400)) < 0.1).astype("f4"), (rng.random((60, 400)) < 0.1).astype("f4")
    w, b = toxicity.fit(p, u, 0.3)
    soft = lambda z: np.logaddexp(0, z)
    assert soft(u @ w + b).mean() - 0.3 * soft(p @ w + b).mean() > -0.05


def test_toxicity_odd_rows(spark, odd, none):
    rows = [(f"you are an idiot number {i}", 1) for i in range(30)] + [(f"a calm and friendly text {i}", None) for i in range(300)]
    rows = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, text string, toxic int")
    model = toxicity.learn(rows.drop("toxic"), rows.select("doc_id", "toxic"), prior=0.1)
    score = toxicity.scorer(model)
    got = {r["text"]: r["s"] for r in odd.withColumn("s", score("text")).collect()}
    assert all(0 <= s <= 1 for s in got.values()) and got[None] == got[""]
    one = spark.createDataFrame([("You are an IDIOT, number 5",), ("calm words",)], "text string").withColumn("s", score("text")).collect()
    assert one[0]["s"] > 0.7 > 0.3 > one[1]["s"]
    assert none.withColumn("s", score("text")).count() == 0
    nothing = toxicity.learn(none, none.withColumn("toxic", F.lit(1)))
    assert all(r["s"] < 1e-9 for r in odd.withColumn("s", toxicity.scorer(nothing)("text")).collect())
