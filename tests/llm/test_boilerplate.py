"""Boilerplate lines against exact counts."""

import struct

import xxhash

from kerbline.llm import boilerplate


def plain(rows, least):
    sites = {}
    for _, t, s in rows:
        for line in (t or "").split("\n"):
            sites.setdefault(line.strip(" \t\r"), set()).add(s)
    wide = {x for x, s in sites.items() if x and len(s) >= least}
    out = []
    for i, t, _ in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if x.strip(" \t\r") not in wide]
        out.append((str(i), "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out)


def got(df, least):
    return sorted((str(r["doc_id"]), r["without"]["kept"], r["without"]["n_lines"], r["without"]["n_removed"]) for r in boilerplate.remove_boilerplate(df, min_sites=least).collect())


def test_threshold_is_exact(spark):
    rows = [(100 * n + i, f"own line {n} {i}\n  on {n} sites\t\nlast", f"site{i}") for n in (1, 2, 40, 49, 50, 51, 60, 90) for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for least in (1, 2, 50):
        assert got(df, least) == plain(rows, least)


def test_odd_rows(odd, odd_rows, none):
    for least in (1, 2, 3):
        assert got(odd, least) == plain([(r[0], r[1], r[3]) for r in odd_rows], least)
    assert boilerplate.remove_boilerplate(none).count() == 0


def test_second_hash_is_no_function_of_the_first(spark):
    df = spark.createDataFrame([(i, f"line {i}\nshared", "s") for i in range(50)], "doc_id long, text string, source string")
    for r in boilerplate.lines_of(df, "doc_id", "text", "source").collect():
        chained = xxhash.xxh64_intdigest(struct.pack("<i", 1), r["h1"] % 2**64)
        assert r["h2"] % 2**64 not in (chained, r["h1"] % 2**64)
