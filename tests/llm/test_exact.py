"""Exact duplicates against a dictionary of texts and against the SQL twin."""

import hashlib
from collections import Counter

import pytest
from compare import compare, connection

from kerbline.llm import exact
from kerbline.llm.catalog import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, name):
    state, _, note = compare(spark, connection(FOLDER), FOLDER, name, QUERIES, ORACLES)
    assert state == "ok", note


@pytest.mark.parametrize("keep", ["max", "min"])
def test_odd_rows(odd, odd_rows, keep):
    groups = {}
    for r in odd_rows:
        groups.setdefault(r[1] or "", []).append(r[0])
    choose = {t: (max if keep == "max" else min)([i for i in ids if i is not None], default=None) for t, ids in groups.items()}
    got = exact.exact_duplicates(odd, keep=keep).collect()
    want = Counter((r[0], choose[r[1] or ""], len(groups[r[1] or ""]), hashlib.sha256((r[1] or "").encode()).digest()) for r in odd_rows)
    assert Counter((r["id"], r["keep_id"], r["group_size"], bytes(r["sha"])) for r in got) == want
    kept = Counter(bytes(r["sha"]) for r in got if r["kept"])
    assert set(kept.values()) == {1} and len(kept) == len(groups)
    rest = exact.drop_duplicates(odd, keep=keep)
    assert rest.columns == odd.columns
    assert Counter((r["doc_id"], r["text"] or "") for r in rest.collect()) == Counter((choose[t], t) for t in groups)


def test_empty(none):
    assert exact.exact_duplicates(none).count() == 0
    assert exact.drop_duplicates(none).count() == 0


def test_hot_group_shrinks_to_one_record(spark):
    df = spark.range(0, 20_000, 1, 16).selectExpr("id as doc_id", "if(id % 3 = 0, 'hot', cast(id as string)) as text")
    rows = exact.fingerprints(df, "doc_id", "text")
    got = exact.keepers(rows, True, parts=16).filter("group_size > 1").collect()
    assert [(r["keep_id"], r["group_size"]) for r in got] == [(19_998, 6667)]
