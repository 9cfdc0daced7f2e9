"""Base spans against the plain patterns, and the disclosure rule on planted data."""

import hashlib
import math
import random
import re

import pytest

from kerbline.llm import pii
from kerbline.llm.catalog import QUERIES

FOLDER = "/root/testdata/sf0.01"
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def checksum(digits):
    return sum(sum(divmod(2 * int(d), 10)) if i % 2 else int(d) for i, d in enumerate(digits[::-1])) % 10 == 0


def plain(text):
    out = []
    for kind, pattern in enumerate((EMAIL, IP, CARD, PHONE)):
        for m in pattern.finditer(text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == 1 and not all(int(x) <= 255 for x in m.group().split(".")):
                continue
            if kind == 2 and not (12 <= len(digits) <= 19 and checksum(digits)):
                continue
            if kind == 3 and not 9 <= len(digits) <= 15:
                continue
            out.append((m.start(), kind, m.end()))
    return sorted(out)


def test_random_texts():
    rng = random.Random(4)
    for _ in range(30_000):
        text = "".join(rng.choice("a1@@..--+  9()%255é４") for _ in range(rng.randint(0, 40)))
        assert pii.base_spans(text) == plain(text)


@pytest.mark.parametrize("text", ["a" * 100_000 + "@", "1" * 100_000, "1." * 50_000, "+1" + " " * 50_000, "@" * 50_000, "a@b." * 20_000, "4111 1111 1111 1111 " * 2000, "٣.٣.٣.٣"])
def test_long_runs_stay_fast(text):
    spans = pii.base_spans(text)
    if len(text) < 10_000:
        assert spans == plain(text)


def test_query_equals_plain_patterns(spark):
    rows = spark.read.parquet(f"{FOLDER}/documents.parquet").collect()
    got = {r["doc_id"]: r for r in QUERIES["op2_pii"](spark, FOLDER).collect()}
    assert len(got) == len(rows)
    for r in rows:
        spans = plain(r["text"])
        base = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in spans)
        g = got[r["doc_id"]]
        assert [g["n_email"], g["n_ip"], g["n_card"], g["n_phone"]] == [sum(k == n for _, k, _ in spans) for n in range(4)]
        assert g["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
        mine = [x for x in g["spans"].split(",") if x and x.split(":")[0] in pii.KINDS[: pii.BASE]]
        assert ",".join(mine) == base
        if not spans:
            assert g["spans"] == ""


def test_telling_terms(spark):
    common = "the meeting was about many things of no weight"
    rows = [(i, f"{common} plain{i}") for i in range(200)]
    rows += [(1000 + i, f"{common} asked zanzibar and quokka of jo@example.org again") for i in range(6)]
    rows += [(2000 + i, f"{common} zanzibar alone") for i in range(6)] + [(3000, "quokka stands here without the address"), (3001, f"{common} other@example.org with hapax")]
    got = {r["doc_id"]: r["sanitised"] for r in pii.sanitise(spark.createDataFrame(rows, "doc_id long, text string"), generalise=0.7, remove=0.93).collect()}
    assert got[1000] == f"{common}  <TERM> and <TERM> of <EMAIL> " or got[1000].count("<EMAIL>") == 1
    assert "quokka" not in got[1000] and "zanzibar" not in got[1000]  # 5/6 and all... of the information
    assert "meeting" in got[1000]  # as common without the address
    assert got[2000] == f"{common} zanzibar alone" and "quokka" in got[3000]  # no entity in the document
    assert "hapax" in got[3001]  # seen beside its entity once: says nothing


def test_odd_rows(odd, odd_rows, none):
    got = pii.private_spans(odd).collect()
    assert len(got) == len(odd_rows) and all(r["spans"] == "" for r in got)
    clean = pii.sanitise(odd)
    assert clean.columns == [*odd.columns, "sanitised"]
    assert sorted(r["sanitised"] for r in clean.collect()) == sorted(r[1] or "" for r in odd_rows)
    assert pii.private_spans(none).count() == 0 and pii.sanitise(none).count() == 0


def test_entities_of_one_document_are_worked_on(spark):
    """All words beside an entity that only one document holds, against the formula on plain counts."""
    rng = random.Random(8)
    rows = [(i, " ".join(f"w{rng.choice('abcdefghij')}{rng.choice('abcdefghij')}x" for _ in range(6))) for i in range(3000)]
    rows = [(i, re.sub(r"w(..)x", r"\1\1", t)) for i, t in rows]
    rows += [(5000, "aaaa met zanzibar at solo@example.org"), (5001, "zanzibar aaaa quiet"), (5002, "quiet zanzibar")]
    got = {r["id"]: r["spans"] for r in pii.private_spans(spark.createDataFrame(rows, "doc_id long, text string"), generalise=0.7, remove=0.77).collect()}
    n, want = len(rows), []
    for m in re.finditer("[a-z]{3,}", rows[3000][1].split(" solo@")[0]):
        df = sum(m.group() in t.split() for _, t in rows)
        share = math.log(n / (df + pii.PRIOR)) / math.log(n)
        want += [f"{'removed' if share >= 0.77 else 'general'}:{m.start()}:{m.end()}"] if share >= 0.7 else []
    assert [x for x in got[5000].split(",") if x.split(":")[0] in pii.KINDS[pii.BASE :]] == want
    assert want == ["removed:5:8", "general:9:17"]  # one document, three documents
