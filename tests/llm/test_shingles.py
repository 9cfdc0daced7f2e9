"""Near copies against Jaccard similarities of all pairs."""

import re
from fractions import Fraction
from itertools import combinations

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from test_simhash import classes

import corpus_pipeline
from kerbline.llm import shingles

FOLDER = "/root/testdata/sf0.001"


def plain_set(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def similar(a, b):
    return 5 * len(a & b) >= 4 * len(a | b)


def plain_groups(rows):
    """Sets of row numbers that hang together by similar pairs."""
    sets = [plain_set(t) for _, t in rows]
    links = [(i, j) for i, j in combinations(range(len(rows)), 2) if 4 * max(len(sets[i]), len(sets[j])) <= 5 * min(len(sets[i]), len(sets[j])) and similar(sets[i], sets[j])]
    root = classes(range(len(rows)), links)
    return [[i for i in root if root[i] == r] for r in set(root.values())]


def plain_kept(rows):
    return sorted(min((rows[i][0] is None, rows[i][0] or 0) for i in g) for g in plain_groups(rows))


def kept(df):
    return sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in df.select("doc_id").collect())


@pytest.mark.parametrize("folder", [FOLDER, "/root/testdata/sf0.01"])
def test_stage_equals_all_pairs(spark, folder):
    rows = duckdb.sql(f"select doc_id, text from '{folder}/documents.parquet'").fetchall()
    got = kept(corpus_pipeline.near_stage(spark, spark.read.parquet(f"{folder}/documents.parquet"), folder))
    assert got == plain_kept(rows)


@pytest.mark.parametrize(("stars", "centres", "crowded"), [(0, 0, 10**9), (1, 0, 5), (0, 2, 20), (2, 3, 48)])
def test_copies_with_changes_and_a_common_passage(spark, monkeypatch, stars, centres, crowded):
    """Copies around the threshold; texts that only share a long passage, which pair up without being similar."""
    monkeypatch.setattr(shingles, "STARS", stars)
    monkeypatch.setattr(shingles, "CENTRES", centres)
    monkeypatch.setattr(shingles.crowded_shingles, "__defaults__", (crowded, shingles.FREQUENT))
    rng = np.random.default_rng(3)
    word = lambda n: [f"w{x}" for x in rng.integers(0, 500, n)]
    rows, passage = [], word(60)
    for base in range(12):
        text = word(int(rng.integers(30, 250)))
        for _ in range(8):
            copy = list(text)
            for at in rng.integers(0, len(copy), int(rng.integers(0, 1 + len(copy) // 25))):
                copy[at] = f"x{rng.integers(0, 10**6)}"
            rows.append((len(rows), " ".join(copy)))
    rows += [(len(rows) + i, " ".join(passage + word(25))) for i in range(30)]
    rows += [(900, "a b c d"), (901, "A b  c D"), (902, "a b c d e"), (903, ""), (904, None), (905, "a b c d")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = plain_kept(rows)
    assert kept(shingles.drop_near_copies(df)) == want and 50 < len(want) < len(rows) - 30


def test_rows_come_out_as_they_went_in(odd, odd_rows, none):
    got = shingles.drop_near_copies(odd)
    assert got.columns == odd.columns and kept(got) == plain_kept([(r[0], r[1]) for r in odd_rows])
    assert shingles.drop_near_copies(none).count() == 0


def test_several_over_any_batches():
    rows = [(1, 1), (2, 1), (2, 1), (2, 2), (3, 5), (3, 5), (4, 1), (4, 2), (4, 3), (5, 1)]
    want = [(2, 1), (2, 2), (4, 1), (4, 2), (4, 3)]
    for step in range(1, 11):
        batches = [pa.record_batch([pa.array([r[0] for r in x]), pa.array([r[1] for r in x]), pa.array([1] * len(x), pa.int32())], schema=shingles.SHARED) for x in (rows[i : i + step] for i in range(0, 10, step))]
        assert [(r["g"], r["v"]) for b in shingles.several(iter(batches)) for r in b.to_pylist()] == want


def test_prefixes_of_similar_sets_meet_in_any_order():
    rng = np.random.default_rng(1)
    for n in range(1, 60):
        a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        b = np.unique(np.r_[a[rng.permutation(len(a))[: max(1, len(a) - n // 9)]], rng.integers(0, 2**63, n // 9, dtype=np.uint64)])
        both, either = shingles.similarity(a, b)
        frequent = (a[::2], rng.integers(2, 9, len(a[::2])))
        if 5 * both >= 4 * either:
            assert set(shingles.prefix(a, frequent, Fraction(4, 5))) & set(shingles.prefix(b, frequent, Fraction(4, 5)))


def test_bitmaps_never_differ_more_than_sets():
    rng = np.random.default_rng(4)
    for n in (1, 2, 63, 64, 65, 200, 500):
        a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        for m in (0, 1, n // 5, n):
            b = np.unique(np.r_[a[m // 2 :], rng.integers(0, 2**63, m + 1, dtype=np.uint64)])
            both, either = shingles.similarity(a, b)
            assert shingles.apart(shingles.parities(a), shingles.parities(b)) <= either - both


def test_folds_never_differ_more_than_sets():
    rng = np.random.default_rng(5)
    for n in (1, 2, 63, 64, 65, 200, 500):
        a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        for m in (0, 1, n // 5, n):
            b = np.unique(np.r_[a[m // 2 :], rng.integers(0, 2**63, m + 1, dtype=np.uint64)])
            both, either = shingles.similarity(a, b)
            differ = sum(((x ^ y) & (2**64 - 1)).bit_count() for x, y in zip(shingles.fold(a), shingles.fold(b), strict=True))
            assert differ <= either - both


def test_candidates_come_from_simhash_first(spark):
    """Five vertices of one fingerprint, one three bits away, one far away: links by one vertex each, no square."""
    marks = spark.createDataFrame([(v, 0b1011) for v in (5, 6, 7, 8, 9)] + [(3, 0b1100_0000_0000_1010), (4, -1)], "v long, fp long")
    sizes = spark.createDataFrame([(v, v * 10) for v in range(3, 10)], "v long, n int")
    got = sorted(map(tuple, shingles.simhash_pairs(marks, sizes).collect()))
    assert got == [(3, 5, 30, 50), *[(5, v, 50, v * 10) for v in (6, 7, 8, 9)]]


def test_near_stage_goes_through_simhash(spark, monkeypatch):
    """The stage is SimHash's: its candidates are asked for, and texts far apart in the end are left alone."""
    asked = []
    plain = shingles.simhash_pairs
    monkeypatch.setattr(shingles, "simhash_pairs", lambda *a: asked.append(1) or plain(*a))
    df = spark.createDataFrame([(i, " ".join(f"w{j}" for j in range(100)) + f" x{i}") for i in range(40)] + [(90, "other words")], "doc_id long, text string")
    assert kept(corpus_pipeline.near_stage(spark, df, FOLDER)) == [(False, 0), (False, 90)] and asked


def test_near_stage_runs_few_jobs(spark):
    """Every exchange takes a thread of the driver for a minute; a chain of near copies once took a round for each doubling, in every turn."""
    words = [f"w{i}" for i in range(460)]
    rows = [(i, " ".join(words[5 * i : 5 * i + 60])) for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    first = spark.sparkContext._jsc.sc().dagScheduler().nextJobId()
    roots = {r["root"] for r in shingles.near_copies(df, least=0.8).collect()}
    jobs = spark.sparkContext._jsc.sc().dagScheduler().nextJobId() - first
    assert len(roots) == 1
    assert jobs < 230  # 294 before edges were contracted and empty steps left out, 169 after


def test_tasks_on_pairs_run_without_kept_words(spark):
    """Workers of a stage that joins shingles once held the words hashed before, some 80 MB each."""
    def kept(batches):
        shingles.shingles("some words that are kept for the next text")
        before = len(shingles._WORDS)
        rows = pa.record_batch([pa.array([1, 1]), pa.array([2, 3]), pa.array([9, 9], pa.int32())], schema=shingles.SHARED)
        seen = shingles.shared_task([rows])
        n = sum(b.num_rows for b in seen)
        yield pa.record_batch({"before": pa.array([before]), "after": pa.array([len(shingles._WORDS)]), "n": pa.array([n])})

    r = spark.range(1).mapInArrow(kept, "before long, after long, n long").first()
    assert r["before"] > 0 and r["after"] == 0 and r["n"] == 2
