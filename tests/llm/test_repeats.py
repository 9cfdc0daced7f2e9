"""Repeated byte strings and word passages against dictionaries of all windows."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from kerbline.llm import exchange, passages, substrings
from kerbline.llm.catalog import QUERIES

FOLDER = "/root/testdata/sf0.001"


def gone(units, counts, window):
    out = [False] * len(units)
    for a in range(len(units) - window + 1):
        if counts[tuple(units[a : a + window])] > 1:
            out[a : a + window] = [True] * window
    return out


def plain(rows, split, glue, window):
    units = [split((t or "").encode()) for _, t in rows]
    counts = Counter(tuple(u[a : a + window]) for u in units for a in range(len(u) - window + 1))
    out = []
    for (i, _), u in zip(rows, units, strict=True):
        mask = gone(u, counts, window)
        kept = glue(x for x, m in zip(u, mask, strict=True) if not m)
        runs = sum(m and (k == 0 or not mask[k - 1]) for k, m in enumerate(mask))
        out.append((str(i), len(u), sum(mask), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def words(rows, window):
    return [(i, n, m, h) for i, n, m, _, h in plain(rows, bytes.split, b" ".join, window)]


def octets(rows, window):
    return plain(rows, lambda b: [bytes([x]) for x in b], b"".join, window)


def tangled(seed, n=60):
    """Texts that share passages at many offsets, some within themselves."""
    rng = random.Random(seed)
    passages_ = [" ".join(rng.choice("abcdefghij") * rng.randint(1, 9) for _ in range(rng.randint(20, 90))) for _ in range(5)]
    out = []
    for i in range(n):
        parts = [" ".join(rng.choice("klmnopqrst") * rng.randint(1, 9) for _ in range(rng.randint(0, 40))) for _ in range(rng.randint(0, 4))]
        parts += [p[rng.randint(0, 30) :] for p in rng.choices(passages_, k=rng.randint(0, 3))]
        rng.shuffle(parts)
        out.append((i, " \n".join(parts)))
    return out


def test_word_query(spark, texts):
    got = QUERIES["op6_substring_dedup"](spark, FOLDER).collect()
    assert sorted((str(r[0]), *r[1:]) for r in got) == words([(t[0], t[1]) for t in texts], 35)


def test_byte_query(spark, texts):
    got = QUERIES["op1_suffix_dedup"](spark, FOLDER).collect()
    few = [(t[0], t[1]) for t in texts]
    counts = Counter()
    for _, t in few:
        b = t.encode()
        counts.update(hash(b[a : a + 400]) for a in range(len(b) - 399))
    want = []
    for i, t in few:
        b = t.encode()
        edge = np.zeros(len(b) + 1, int)
        for a in range(len(b) - 399):
            if counts[hash(b[a : a + 400])] > 1:
                edge[a] += 1
                edge[a + 400] -= 1
        mask = np.cumsum(edge[:-1]) > 0
        runs = int((np.diff(np.r_[0, mask.astype(int)]) == 1).sum())
        want.append((i, len(b), int(mask.sum()), runs, hashlib.sha256(np.frombuffer(b, np.uint8)[~mask].tobytes()).hexdigest()))
    assert sorted(tuple(r) for r in got) == sorted(want)


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("window", [1, 2, 5, 20])
def test_tangled_words(spark, seed, window):
    rows = tangled(seed)
    got = substrings.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), window=window).collect()
    assert sorted((str(r["id"]), r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got) == words(rows, window)


@pytest.mark.parametrize("seed,window,hot", [(3, 48, 4000), (4, 100, 4000), (5, 60, 3), (6, 200, 0)])
def test_tangled_bytes(spark, seed, window, hot):
    """``hot`` small: buckets go the way of those too large for a task."""
    rows = tangled(seed, 40) + [(1000, "z" * 700), (1001, "zy" * 300), (1002, "z" * 150)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = passages.remove_repeats(df, window=window, hot=hot).collect()
    assert sorted((str(r["id"]), r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == octets(rows, window)


def test_odd_rows(odd, odd_rows, none):
    rows = [(r[0], r[1]) for r in odd_rows]
    got = substrings.repeated_passages(odd, window=5).collect()
    assert sorted((str(r["id"]), r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got) == words(rows, 5)
    short = odd.filter("text is null or length(text) < 5000")
    rows = [r for r in rows if len(r[1] or "") < 5000]
    got = passages.remove_repeats(short, window=60).collect()
    assert sorted((str(r["id"]), r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == octets(rows, 60)
    assert substrings.repeated_passages(none).count() == 0 and passages.remove_repeats(none).count() == 0
    with pytest.raises(ValueError):
        passages.remove_repeats(odd, window=10)


def test_packed_entries_come_back():
    rng = np.random.default_rng(2)
    numbers = np.sort(rng.integers(0, 2**64, 1000, dtype=np.uint64))
    at, marks = rng.integers(0, 2**32, 1000), rng.integers(0, 8, 1000).astype(np.uint8)
    back = exchange.unpack(exchange.pack(numbers, at, marks))
    assert all((a == b).all() for a, b in zip(back, (numbers, at, marks), strict=True))


def test_places_and_spans():
    for at in ([], [3], [0, 1, 2], [1, 2, 5, 9, 10]):
        assert exchange.places_of(exchange.spans_of(np.array(at, np.int64))).tolist() == at


def test_settled_numbers_send_one_entry():
    numbers = np.array([7] * 500 + [9], np.uint64)
    sent = list(exchange.send(numbers, exchange.partition(numbers, 4), np.arange(501), np.r_[True, np.zeros(500, bool)], 4, True))
    assert [e for p, e in sent if p == exchange.SETTLED] == [np.array([0, 500], "<i4").tobytes()]
    assert sum(len(exchange.unpack(e)[0]) for p, e in sent if p >= 0) == 2
