"""The audit against a plain program."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from kerbline.llm import divergence


def plain(rows, least, top=50):
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))) for lang, source, text in rows]
    frequency, counts, out = defaultdict(Counter), defaultdict(Counter), []
    for lang, source, words in docs:
        frequency[lang].update(set(words))
        counts[lang, source].update(words)
    for lang in {d[0] for d in docs}:
        kept = [t for t, n in frequency[lang].items() if n >= least]
        sources = [s for x, s in counts if x == lang]

        def shares(c):
            total = sum(c[t] for t in kept) + 5 * len(kept)
            return {t: 1 + 10**9 * (c[t] + 5) // total for t in kept}

        whole = shares(sum((counts[lang, s] for s in sources), Counter()))
        p = {s: shares(counts[lang, s]) for s in sources}
        for s in sources:
            pairs = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in sources if o != s]
            over = [(p[s][t] - whole[t], t) for t in kept if counts[lang, s][t] and p[s][t] > whole[t]]
            for part, found, most in (("pair", pairs, len(pairs)), ("term", over, top)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, k) for k, (value, item) in enumerate(found[:most], 1)]
    return sorted(out)


def got(df, **kw):
    return sorted(tuple(r) for r in divergence.audit(df, **kw).collect())


WORDS = ["the", "The", "café", "x\u00a0y", "ÀB", "a1b", "don't", "中文", "zz"]


def made(n):
    rng = np.random.default_rng(n)
    return [(str(rng.choice(["en", "de"])), f"s{min(3, rng.integers(0, 9))}", " ".join(rng.choice(WORDS, 12)) + f" w{chr(97 + rng.integers(0, 26))}{chr(97 + rng.integers(0, 3))}") for _ in range(n)]


@pytest.mark.parametrize("small", [False, True])
def test_equal_to_a_plain_program(spark, monkeypatch, small):
    if small:  # many shards, blocks, tiles and hand-overs; they are read on the driver or travel with the task functions
        for name, value in {"SHARD_TERMS": 4, "BLOCK_SHARDS": 2, "TILE_SOURCES": 2, "TILE_TERMS": 5}.items():
            monkeypatch.setattr(divergence, name, value)
    rows = [*made(400), ("fr", "lone", "un deux"), ("it", "a", "1 2"), ("it", "b", None), (None, None, "nul"), ("", "q", "nul nul")]
    df = spark.createDataFrame(rows, "lang string, source string, text string").repartition(7)
    for least in (1, 30):
        assert got(df, min_docs=least) == plain(rows, least)


def test_odd_rows(odd, odd_rows, none):
    rows = [(r[2], r[3], r[1]) for r in odd_rows]
    assert got(odd, min_docs=2) == plain(rows, 2) and got(odd) == plain(rows, 30)
    assert got(none) == []


def test_stores_hand_over_early(monkeypatch):
    """A task that may hold little passes on the same sums."""
    import pickle
    from types import SimpleNamespace

    import pyarrow as pa

    rows = made(300)
    keys = sorted({lang.encode() + b"\0" + t for lang, _, text in rows for t in divergence.terms(text.encode())})
    shapes = SimpleNamespace(value=[(0, pickle.dumps(divergence.Shard(keys[::2])))])
    batches = [pa.record_batch([pa.array([r[0] for r in x]), pa.array([r[1] for r in x]), pa.array([r[2].encode() for r in x])], names=["lang", "source", "text"]) for x in (rows[:150], rows[150:])]

    def sums():
        out = Counter()
        for b in divergence._count(shapes, 1)(iter(batches)):
            for r in b.to_pylist():
                out[r["lang"], r["source"], r["term"]] += r["n"]
        return out

    want = Counter()
    for lang, source, text in rows:
        for t in divergence.terms(text.encode()):
            if lang.encode() + b"\0" + t in keys[::2]:
                want[lang, source, t] += 1
    assert sums() == want
    monkeypatch.setattr(divergence, "STORE", 3)
    monkeypatch.setattr(divergence, "DENSE_BYTES", 10)
    assert sums() == want


def test_equal_hashes_get_another_seed(monkeypatch):
    real = divergence.xxhash.xxh64_intdigest
    monkeypatch.setattr(divergence.xxhash, "xxh64_intdigest", lambda k, seed: 5 if seed == 0 else real(k, seed))
    shard = divergence.Shard([b"en\0a", b"en\0b"])
    assert shard.seed == 1 and sorted(shard.find([b"en\0b", b"en\0a", b"en\0c"]).tolist()) == [-1, 0, 1]
