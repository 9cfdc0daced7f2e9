"""Aligned tokens against a plain program that walks both sequences of a whole text."""

import hashlib
import re
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from kerbline.llm import alignment

PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def plain(texts):
    a = Tokenizer.from_file(PATHS[0])
    a.no_truncation()
    a.no_padding()
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    rest = iter(range(256, 400))
    letters = {chr(c) if 33 <= c <= 126 or 161 <= c <= 172 or 174 <= c <= 255 else chr(next(rest)): c for c in range(256)}

    def bytes_b(i):
        piece = b.id_to_piece(i)
        m = re.fullmatch("<0x(..)>", piece)
        return bytes([int(m[1], 16)]) if m else piece.replace("▁", " ").encode()

    found = []
    for text in texts:
        raw = f" {text or ''}".encode()
        x, y = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text, num_threads=1)) if text else ([], [])
        bx, by = [bytes(letters[c] for c in a.id_to_token(i)) if i != 50256 else b"<|endoftext|>" for i in x], [bytes_b(i) for i in y]
        if b"".join(bx) != raw or b"".join(by) != raw:
            found.append(([], [], 0, []))
            continue
        links, groups, i, j, at, bt = [], [[[], []]], 0, 0, 0, 0  # bytes read by both
        new_a = new_b = True
        while i < len(x):
            if new_a:
                groups[-1][0].append(x[i])
            if new_b:
                groups[-1][1].append(y[j])
            links.append((x[i], y[j]))
            ea, eb = at + len(bx[i]), bt + len(by[j])
            new_a, new_b = ea <= eb, eb <= ea
            if new_a:
                i, at = i + 1, ea
            if new_b:
                j, bt = j + 1, eb
            if new_a and new_b:
                groups.append([[], []])
        found.append((x, y, groups[:-1], links))
    count = Counter(k for *_, links in found for k in links)
    best = Counter()
    for (_, j), n in count.items():
        best[j] = max(best[j], n)
    out = []
    for x, y, groups, links in found:
        said = ";".join("|".join(",".join(map(str, side)) for side in g) for g in groups or [])
        out.append((len(x), len(y), len(groups or []), len(links), sum(count[k] == best[k[1]] for k in links), sum(count[k] for k in links), hashlib.sha256(said.encode()).hexdigest() if x else ""))
    return out


@pytest.fixture(scope="module")
def pair(spark):
    return alignment.Pair(spark, *PATHS)


def got(df, pair):
    return sorted((str(r["doc_id"]), *r[1:]) for r in alignment.align(df, pair).collect())


def check(df, rows, pair):
    assert got(df, pair) == sorted((str(i), *f) for (i, _), f in zip(rows, plain([t for _, t in rows]), strict=True))


def test_table(small, texts, pair):
    check(small, [(r[0], r[1]) for r in texts], pair)


ODD = [
    "a", " a", "a ", "  ", " ", "\n", "a\n b", "a  b   c", "x\u00a0 y", "x\x1c y", "x\x85 y", "tab\t x", "▁ x", "a▁b c", "ｆｕｌｌ ｗｉｄｔｈ", "ﬁ ligature", "e\u0301 x", "<s> </s> <unk> <0x41> <|endoftext|> x",
    "don't we'll  've", "日本語 テキスト 😀😀 x", "\u200b zero", "a\x00b c", "0123456789 " * 9, "ab" * 5000, "\r\n \r\n x", "word " * 300, "\u3000 x",
]


@pytest.mark.parametrize("blocks", [1, 3])
def test_odd_texts(spark, monkeypatch, pair, blocks):
    if blocks > 1:
        monkeypatch.setattr(alignment, "BLOCK_BYTES", 4000)
        monkeypatch.setattr(alignment, "FAN", 2)
    rows = list(enumerate([*ODD, *ODD[:9], " ".join(ODD)]))
    check(spark.createDataFrame(rows, "doc_id long, text string").repartition(6), rows, pair)


def test_odd_rows(odd, odd_rows, none, pair):
    check(odd, [(r[0], r[1]) for r in odd_rows], pair)
    assert got(none, pair) == []


def test_store_and_runs_that_fill_up(monkeypatch):
    """A worker that forgets parts after every slice gives the same figures."""
    with open(PATHS[0]) as a, open(PATHS[1], "rb") as b:
        aligner = alignment.Aligner(a.read(), b.read())
    want = plain(ODD)
    monkeypatch.setattr(alignment, "PART_BYTES", 9000)  # parts met twice stay
    for text in [*ODD, *ODD[::-1]] * 2:
        aligner.plan([text])
    assert 0 < len(aligner.number_of) < 200
    monkeypatch.setattr(alignment, "PART_BYTES", 10)
    for text, (n_a, n_b, n_groups, n_links, _, _, said) in zip(ODD, want, strict=True):
        plan = aligner.plan([text])[0]
        assert aligner.figures[plan].sum(0).tolist() == [n_a, n_b, n_groups, n_links]
        assert said == (hashlib.sha256("".join(aligner.groups[i] for i in plan)[:-1].encode()).hexdigest() if len(plan) else "")
