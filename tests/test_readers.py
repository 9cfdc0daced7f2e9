"""Delimited files: dialects, encodings, and what goes to the quarantine."""

import json

from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kerbline.sources import delimited as D
from kerbline.sources import records as J

NAMES = ["id", "name"]


def parsed(raw: bytes, columns=NAMES, required=()):
    return list(D.parse_file(raw, list(columns), list(required)))


def test_quoted_cells_stay_whole():
    raw = b'id,name\r\n1,"x, y"\r\n2,"a ""b""\nc"\r\n3,z\r\n'
    assert parsed(raw) == [(2, ["1", "x, y"], None), (3, ["2", 'a "b"\nc'], None), (5, ["3", "z"], None)]


def test_a_tab_in_the_header_makes_tabs_the_separator():
    assert parsed("id\tname\n1\t가, 나\n".encode("cp949")) == [(2, ["1", "가, 나"], None)]
    assert parsed("a,b,id\tname\n1\t2\n".encode(), ["name"]) == [(2, ["2"], None)]


def test_byte_order_mark_spaces_blank_lines_and_short_rows():
    assert parsed("\ufeff id , name\n\n  \n1\n".encode()) == [(4, ["1", None], None)]


def test_rejects():
    assert parsed(b"\xff\xff") == [(0, None, "no known encoding fits")]
    assert parsed(b"id,other\n1,2\n", required=["name"]) == [(0, None, "column missing: name")]
    assert parsed(b"", required=NAMES) == [(0, None, "column missing: id, name")]
    assert parsed(b"") == []
    assert parsed(b"id,name\n1,2,3\n4,5\n") == [(2, ["1", "2", "3"], "more cells than columns"), (3, ["4", "5"], None)]


@given(st.lists(st.lists(st.text(st.characters(codec="utf-8", exclude_characters="\0")), min_size=2, max_size=2), max_size=6), st.sampled_from(",\t"))
def test_round_trip(rows, sep):
    def quoted(cells):
        return sep.join('"' + c.replace('"', '""') + '"' for c in cells)

    raw = "\n".join(map(quoted, [NAMES, *rows])).encode()
    assert [cells for _, cells, reason in parsed(raw)] == rows


def test_files_and_quarantine(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes('id,name\n1,"x, y"\n2,b,c\n'.encode("utf-8"))
    (tmp_path / "b.csv").write_bytes("name\tid\n나\t3\n".encode("cp949"))
    (tmp_path / "c.csv").write_bytes(b"id\n9\n")
    scanned = D.scan_any_csv(spark, str(tmp_path / "*.csv"), NAMES, NAMES)
    assert sorted(map(tuple, D.good_rows(scanned, NAMES).drop("path").collect())) == [("a.csv", "1", "x, y"), ("b.csv", "3", "나")]
    bad = [(r["path"].rpartition("/")[2], r["line"], r["cells"], r["reason"]) for r in D.rejects(scanned).collect()]
    assert sorted(bad) == [("a.csv", 3, ["2", "b", "c"], "more cells than columns"), ("c.csv", 0, None, "column missing: name")]
    assert D.read_any_csv(spark, str(tmp_path / "c.csv"), NAMES).collect() == [("c.csv", "9", None)]


def test_collections_round_trip(spark, tmp_path):
    rows = spark.range(50).selectExpr("if(id=7, null, id) as id", "id * 0.5D as x", "'\u00e4 \"q\"' as name")
    text = F.when(F.col("id").isNotNull(), J.to_feature(J.point_geometry("x", "x"), ["id", "name"], "id"))
    J.write_collections(rows.select(text.alias("value")), str(tmp_path / "c"), {"note": "a \"b\""}, files=3)
    docs = [json.loads(f.read_text(encoding="utf-8")) for f in (tmp_path / "c").glob("part-*")]
    assert sum(len(d["features"]) for d in docs) == 49 and all(d["metadata"] == {"note": 'a "b"', "feature_count": len(d["features"])} for d in docs)
    back = J.read_feature_collection(spark, str(tmp_path / "c"), "id:bigint,name:string", "array<double>").select("properties.*", "geometry.coordinates").collect()
    assert sorted((r.id, r.name, r.coordinates) for r in back) == [(i, 'ä "q"', [i * 0.5] * 2) for i in range(50) if i != 7]
    J.write_collections(rows.select(text.alias("value")).limit(0), str(tmp_path / "none"))
    empty = [json.loads(f.read_text()) for f in (tmp_path / "none").glob("part-*")]
    assert empty == [{"type": "FeatureCollection", "features": [], "metadata": {"feature_count": 0}}]
