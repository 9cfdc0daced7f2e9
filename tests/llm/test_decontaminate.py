"""Benchmark passages against plain edit distances."""

import random

import duckdb
import pytest

from kerbline.llm import decontaminate as D
from kerbline.llm.catalog import QUERIES

FOLDER = "/root/testdata/sf0.001"


def distance(item, text):
    """Smallest edit distance of ``item`` to a substring of ``text``."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        now = [i]
        for j, b in enumerate(text, 1):
            now.append(min(row[j] + 1, now[-1] + 1, row[j - 1] + (a != b)))
        row = now
    return min(row)


def plain_hits(text, items):
    """Ids of the items within their budget; exact containment first, as full distances are slow."""
    low = D.level(text or "")
    out = []
    for i, item in items:
        item = D.level(item or "")
        if len(item) < D.MIN_CHARS:
            continue
        if item in low or (any(item[a : a + 12] in low for a in range(0, len(item) - 12, 4)) and distance(item, low) <= int(len(item) * D.ERROR_RATE)):
            out.append(i)
    return out


def test_query_equals_plain_distances(spark, texts):
    items = duckdb.sql(f"select item_id, text from '{FOLDER}/benchmark.parquet'").fetchall()
    want = sorted((d, i) for d, t, *_ in texts for i in plain_hits(t, items))
    got = QUERIES["op10_decontamination"](spark, FOLDER).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in got) == want and want


def test_edits_are_found_up_to_the_budget():
    rng = random.Random(9)
    letters = "abcdefgh "
    for trial in range(150):
        item = "".join(rng.choice(letters) for _ in range(rng.randint(24, 120)))
        k = int(len(item) * 0.1)
        text = list(item)
        for _ in range(rng.randint(0, k + 2)):
            at = rng.randrange(len(text))
            kind = rng.randrange(3)
            if kind == 0:
                text[at] = rng.choice(letters)
            elif kind == 1:
                text.insert(at, rng.choice(letters))
            else:
                del text[at]
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) + "".join(text) + "".join(rng.choice(letters) for _ in range(rng.randint(0, 60)))
        want = distance(item, text)
        got = D.Finder([(trial, item)], 0.1).find(text)
        assert bool(got) == (want <= k)
        if got:
            _, d, start, end = got[0]
            assert d == want and distance(item, text[start:end]) == d and abs(end - start - len(item)) <= k


def test_repeated_pieces_and_levels():
    item = "The Same Words again and again and again."
    text = "again and " * 5000 + "the same\twords AGAIN and again and again." + " again" * 5000
    (found,) = D.Finder([(1, item)], 0.05).find(text)
    assert found == (1, 0, 50_000, 50_000 + len(item))
    assert D.level("İSTANBUL\n") == "İstanbul " and len(D.level("İ x")) == 3


def test_odd_rows(spark, odd, none):
    items = spark.createDataFrame([(1, "one two"), (2, None), (3, ""), (4, "no id here, but words enough to"), (4, "other text under the same id")], "item_id long, text string")
    got = D.find_passages(odd, items).collect()
    assert sorted((str(r["doc_id"]), r["item_id"], r["distance"]) for r in got) == [("8", 4, 0), ("None", 4, 0)]
    rest = D.without_passages(odd, items)
    assert rest.columns == odd.columns and rest.count() == odd.count() - 2
    assert D.find_passages(none, items).count() == 0
    assert D.find_passages(odd, items.limit(0)).count() == 0 and D.without_passages(odd, items.limit(0)).count() == odd.count()


@pytest.mark.parametrize("block", [10, 40, 10**6])
def test_blocks_give_the_same(spark, small, block):
    items = spark.read.parquet(f"{FOLDER}/benchmark.parquet").limit(6)
    found = {(r["doc_id"], r["item_id"]) for r in D.find_passages(small, items, block_chars=block * 20).collect()}
    assert found == {(r["doc_id"], r["item_id"]) for r in D.find_passages(small, items).collect()}


def test_short_items_are_found_as_whole_words(spark):
    items = [(1, "42"), (2, " E = mc2 "), (3, "the quick brown fox ju"), (4, " "), (5, None)]
    finder = D.Finder(items, D.ERROR_RATE, short=True)
    assert finder.find_all("42 and 142, 420; e = mc2. (42)") == [(1, 0, 0, 2), (1, 0, 27, 29), (2, 0, 17, 24)]
    assert finder.find("so the quikc brown fox ju") == [] and finder.find("a the quik brown fox ju") == [(3, 1, 2, 23)]
    assert finder.find("the quick brown fox jumps") == [] and finder.find("E = mc²") == []
    docs = spark.createDataFrame([(1, "it is 42 then"), (2, "it is 421 then"), (3, "no e = mc3")], "doc_id long, text string")
    table = spark.createDataFrame(items, "item_id long, text string")
    assert [r["doc_id"] for r in D.find_passages(docs, table, short=True).collect()] == [1]
    assert sorted(r["doc_id"] for r in D.without_passages(docs, table, short=True).collect()) == [2, 3]


def test_every_separate_occurrence_is_given(spark):
    rng = random.Random(2)
    item = "".join(rng.choice("abcdefgh ") for _ in range(60))
    edited = item[:20] + "#" + item[21:40] + item[41:]
    for gap in ("", "!", "." * 300):
        text = gap.join([item, edited, item, edited])
        got, at = D.Finder([(7, item)], 0.05).find_all(text), 0
        assert [d for _, d, *_ in got] == [0, 2, 0, 2]
        for (_, _, a, b), own in zip(got, (item, edited, item, edited), strict=True):
            at = text.index(own, at)
            assert (a, b) == (at, at + len(own))
            at = b
    many = item * 3000
    assert len(D.Finder([(7, item)], 0.05).find_all(many)) == 3000
    docs = spark.createDataFrame([(1, gap.join([item, edited]))], "doc_id long, text string")
    table = spark.createDataFrame([(7, item)], "item_id long, text string")
    assert D.find_passages(docs, table, every=True).count() == 2 and D.find_passages(docs, table).count() == 1
