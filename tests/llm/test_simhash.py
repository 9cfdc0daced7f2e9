"""SimHash fingerprints, the bit-sliced comparison and the components, against brute force."""

import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from kerbline.llm import simhash
from kerbline.llm.catalog import QUERIES
from kerbline.llm.components import components
from kerbline.operators.contract import contracted

FOLDER = "/root/testdata/sf0.001"


def plain_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    runs = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64(r.encode(), seed=42).intdigest() for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(items, links):
    """Smallest member of each item's component."""
    up = {x: x for x in items}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {x: find(x) for x in items}


def near(prints, radius=4):
    return [(a, b) for i, a in enumerate(prints) for b in prints[i + 1 :] if bin((a ^ b) & (2**64 - 1)).count("1") <= radius]


def expected(rows):
    prints = {}
    for doc_id, text in rows:
        prints.setdefault(plain_fingerprint(text), []).append(doc_id)
    root = classes(list(prints), near(list(prints)))
    least = {}
    for fp, ids in prints.items():
        known = [i for i in ids if i is not None] + [x for x in [least.get(root[fp])] if x is not None]
        least[root[fp]] = min(known) if known else None
    return sorted((str(i), f"{fp:016x}", str(least[root[fp]])) for fp, ids in prints.items() for i in ids)


def test_query_equals_brute_force(spark, texts):
    got = QUERIES["op8_simhash"](spark, FOLDER).collect()
    assert sorted((str(r[0]), r[1], str(r[2])) for r in got) == expected([(t[0], t[1]) for t in texts])


def test_odd_rows(odd, odd_rows):
    got = simhash.near_duplicates(odd).collect()
    assert sorted((str(r["id"]), f"{r['fp'] & (2**64 - 1):016x}", str(r["component"])) for r in got) == expected([(r[0], r[1]) for r in odd_rows])


def test_empty(none):
    assert simhash.near_duplicates(none).count() == 0


@pytest.mark.parametrize("n", [1, 63, 64, 65, 300])
def test_link_connects_what_is_near(n):
    rng = np.random.default_rng(n)
    base = rng.integers(0, 2**64, 6, dtype=np.uint64)
    prints = base[rng.integers(0, 6, n)]
    for _ in range(3):
        prints ^= np.uint64(1) << rng.integers(0, 64, n, dtype=np.uint64)
    prints = np.unique(prints)
    group = np.sort(rng.integers(0, 3, len(prints)))
    a, b = simhash.link(prints, group)
    p = [int(x) for x in prints]
    got = classes(range(len(p)), list(zip(a.tolist(), b.tolist(), strict=True)))
    want = classes(range(len(p)), [(i, j) for i in range(len(p)) for j in range(i + 1, len(p)) if group[i] == group[j] and (p[i] ^ p[j]).bit_count() <= 4])
    assert got == want
    assert all((p[i] ^ p[j]).bit_count() <= 4 for i, j in zip(a, b, strict=True))
    assert len(a) < len(p)


def test_key_choices_meet_all_neighbours():
    rng = np.random.default_rng(0)
    for n in (10, 10**6, 10**9, 10**12):
        blocks, chosen = simhash.choice(n, 4)
        m = simhash.masks(blocks, chosen)
        for _ in range(200):
            flips = sum(1 << int(b) for b in rng.choice(64, 4, replace=False))
            assert any(flips & x == 0 for x in m)


def test_large_group_is_cut_without_losing_links(spark):
    base = 0x0123456789ABCDEF
    prints = sorted({base ^ (1 << i) ^ (1 << j) for i in range(40) for j in range(i)})
    df = spark.createDataFrame([(simhash.signed(p),) for p in prints], "fp long")
    edges = simhash.near_edges(df, group=50).collect()
    got = classes([simhash.signed(p) for p in prints], [(r["a"], r["b"]) for r in edges])
    assert len(set(got.values())) == 1


def test_components_of_paths_and_hubs(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(500, 501), (501, 500), (7, 7)]
    got = {r["v"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 160)}, 500: 500, 501: 500}
    assert components(spark.createDataFrame([], "a long, b long").select(F.col("a"), F.col("b"))).count() == 0


def test_contraction_keeps_components(spark):
    rng = np.random.default_rng(5)
    links = [(i, i + 1) for i in range(300)] + [tuple(map(int, rng.integers(1000, 1400, 2))) for _ in range(250)]
    df = spark.createDataFrame(links, "a long, b long").repartition(3)
    for chunk in (7, 500_000):
        short = contracted(df, chunk)
        edges = [(r["a"], r["b"]) for r in short.collect()]
        assert len(edges) <= len(links)
        want = classes({x for e in links for x in e if e[0] != e[1]}, links)
        assert {r["v"]: r["root"] for r in components(short).collect()} == want
    assert contracted(df.limit(0)).count() == 0
