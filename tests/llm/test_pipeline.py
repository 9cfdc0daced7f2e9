"""The pipeline against a plain program over the same documents."""

import hashlib
import re

import duckdb
import numpy as np
import public_tokenizers
from test_decontaminate import plain_hits
from test_shingles import plain_groups
from tokenizers import Tokenizer

import corpus_pipeline
from kerbline.llm import langid
from kerbline.llm.texts import documents, held_out

FOLDER = "/root/testdata/sf0.001"


def test_rows_equal_a_plain_program(spark, texts):
    docs = documents(spark, FOLDER)
    known = langid.Compressors(langid.learn(docs.filter(~held_out(docs["doc_id"])), "text", "lang"))
    left = {i: t for i, t, *_ in texts if not known.predict(t, langid.MIN_MARGIN)[2]}
    last = {}
    for i, t in left.items():
        last[t] = max(i, last.get(t, i))
    left = {i: t for t, i in last.items()}
    rows = list(left.items())
    left = {min(rows[k][0] for k in group): left[min(rows[k][0] for k in group)] for group in plain_groups(rows)}
    items = duckdb.sql(f"select item_id, text from '{FOLDER}/benchmark.parquet'").fetchall()
    left = {i: t for i, t in left.items() if not plain_hits(t, items)}
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.no_truncation()
    t.no_padding()
    want = {i: np.array(t.encode(x, add_special_tokens=False).ids, "<u4").tobytes() for i, x in left.items()}
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, FOLDER).collect()}
    assert got.keys() == want.keys()
    for i, ids in want.items():
        assert got[i]["n_tokens"] == len(ids) // 4 and got[i]["ids_sha256"] == hashlib.sha256(ids).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(left[i].encode()).hexdigest()
    assert 0.5 * len(texts) < len(want) < len(texts)


def test_stages_keep_columns_and_take_odd_rows(spark, odd, none):
    for df in (odd, none):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            after = stage(spark, df, FOLDER)
            assert after.columns == df.columns
            assert after.count() <= df.count()
        assert corpus_pipeline.STAGES[-1][1](spark, df, FOLDER).count() == df.count()
    near_ = corpus_pipeline.near_stage(spark, odd, FOLDER).collect()
    assert len({re.sub(r"\s+", " ", (r["text"] or "").strip().lower()) for r in near_}) == len(near_)
