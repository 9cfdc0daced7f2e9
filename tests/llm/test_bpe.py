"""The automaton against the public library, and round trips."""

import hashlib
import pickle
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from kerbline.llm import bpe
from kerbline.llm.catalog import QUERIES

FOLDER = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


@pytest.fixture(scope="module")
def automaton():
    with open(PATH, encoding="utf-8") as f:
        return bpe.Automaton(f.read())


def packed(library, text):
    return np.array(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_query_equals_library(spark, texts, library):
    got = {r["doc_id"]: r for r in QUERIES["op5_bpe"](spark, FOLDER).collect()}
    assert len(got) == len(texts)
    for doc_id, text, *_ in texts:
        ids = packed(library, text or "")
        assert got[doc_id]["n_tokens"] == len(ids) // 4
        assert got[doc_id]["ids_sha256"] == hashlib.sha256(ids).hexdigest()
        back = library.decode(np.frombuffer(ids, "<u4").tolist(), skip_special_tokens=False)
        assert got[doc_id]["decoded_sha256"] == hashlib.sha256(back.encode()).hexdigest()


def test_random_strings(library, automaton):
    rng = random.Random(1)
    letters = "aab  \n\t'sStheré中文😀1２²\x1c\x85​ .,-_<|endoftext|>́ßſ١"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 30))) for _ in range(6000)]
    texts[::7] = [t[:8] + "<|endoftext|>" + t[8:] for t in texts[::7]]
    got = automaton.encode_all(texts)
    assert got == [packed(library, t) for t in texts]
    assert [automaton.decode(x) for x in got] == texts


@pytest.mark.parametrize("text", ["a" * 20_000, " " * 20_000, "ab" * 9000, "the" * 9000, "\n" * 999 + "x", "  two  spaces "])
def test_long_words(library, automaton, text):
    assert automaton.encode(text) == packed(library, text)


def test_stores_may_be_emptied(library, automaton, monkeypatch):
    for name in ("KEPT_WORDS", "KEPT_PIECES", "KEPT_ARCS"):
        monkeypatch.setattr(bpe, name, 3)
    text = "some words that fill the stores again and again " * 3
    assert automaton.encode(text) == packed(library, text)


def test_packed_automaton_is_the_same(automaton, library):
    packed_ = pickle.loads(pickle.dumps(automaton, protocol=5))
    texts = ["Some words, and don't  mind <|endoftext|> the 中文 😀 rest\n", "", " x" * 50]
    assert packed_.encode_all(texts) == [packed(library, t) for t in texts]
    assert [packed_.decode(x) for x in packed_.encode_all(texts)] == texts


def test_odd_rows(spark, odd, odd_rows, none):
    tokenizer = bpe.Source(spark, PATH)
    got = bpe.decode(bpe.encode(odd, "text", tokenizer), "ids", tokenizer).collect()
    assert sorted(r["decoded"] for r in got) == sorted(r[1] or "" for r in odd_rows)
    assert bpe.decode(bpe.encode(none, "text", tokenizer), "ids", tokenizer).count() == 0
