import random

import duckdb
import pytest

FOLDER = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
# names that the operators use inside; a caller's own columns may have them too
EXTRA = ", key string, id string, g string, fp string, sha string, size string, home string, run string, h1 string, pos string, word string, kept string, a string, b string, t string, d string, u string, v string, root string, n string"
N_EXTRA = EXTRA.count(" string")


@pytest.fixture(scope="session")
def texts():
    """(doc_id, text, lang, source) of the smallest table."""
    return duckdb.sql(f"select doc_id, text, lang, source from '{FOLDER}/documents.parquet' order by doc_id").fetchall()


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and very long texts, repeated rows, a repeated id, white space of all kinds."""
    rng = random.Random(5)
    long = " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "eps"]) + str(rng.randrange(400)) for _ in range(30_000))
    rows = [
        (1, None, "en", "s0"), (2, "", None, None), (3, "   \n\t ", "en", "s1"), (4, "one two", "en", "s1"), (5, "x" * 3000, None, "s2"), (6, long, "en", "s0"),
        (7, long[: len(long) // 2] + " changed " + long[len(long) // 2 :], "en", None), (8, "one two", "de", "s2"), (8, "one two", "de", "s2"), (8, "other text under the same id", "de", "s3"),
        (None, "no id here, but words enough to shingle", "en", "s0"), (None, None, None, None), (11, "Ünïcödé 中文 text 😀 " * 40, "fr", "s4"), (12, long, "en", "s5"), (13, "\r\n\x0b\x0c a\x00b \x85 c", "en", "s6"),
    ]
    return [(i, t, lang, s, len(t or "")) for i, t, lang, s in rows]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame([(*r, *["?"] * N_EXTRA) for r in odd_rows], COLUMNS + EXTRA).repartition(4)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], COLUMNS + EXTRA)


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")
