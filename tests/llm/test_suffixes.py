"""Two-stage suffix sorting against plain sorting."""

import random

import numpy as np
import pytest

from kerbline.llm import suffixes as S

RNG = random.Random(3)
TEXTS = [b"", b"a", b"aaaaaaaaaaaaaaaaaaaaaaaaa", b"banana", b"mississippi", b"abababababababab", bytes(range(256)), bytes(reversed(range(256))), b"\x00\x00\xff\x00\x00",
         b"zyxwvutsrqponmlkjihgfedcba" * 5, b"a" * 40 + b"b" + b"a" * 40] + [bytes(RNG.choice(b"ab" if i % 2 else b"abcdxyz\x00\xff") for _ in range(RNG.randint(1, 300))) for i in range(120)]


@pytest.mark.parametrize("text", TEXTS)
def test_order_and_prefixes(text):
    t = np.frombuffer(text, np.uint8)
    n = len(text)
    full = S.suffix_order(t, n + 1).tolist()
    assert full == sorted(range(n), key=lambda i: text[i:])
    assert S.smaller_than_next(t).tolist() == [text[i:] < text[i + 1 :] for i in range(n)]
    a, b = np.array(full[:-1], np.int64), np.array(full[1:], np.int64)

    def lcp(i, j):
        k = 0
        while max(i, j) + k < n and text[i + k] == text[j + k]:
            k += 1
        return k

    for limit in (1, 5, 8, 13, 300):
        assert S.common_prefixes(t, a, b, limit).tolist() == [min(limit, lcp(i, j)) for i, j in zip(a, b, strict=True)]


@pytest.mark.parametrize("window", [1, 3, 9, 20])
def test_repeated_starts(window):
    for text in TEXTS:
        starts = [i for i in range(len(text) - window + 1) if i % 5 != 2]
        runs = [text[i : i + window] for i in starts]
        got = S.repeated_starts(np.frombuffer(text, np.uint8), np.array(starts, np.int64), window)
        assert got.tolist() == [runs.count(r) > 1 for r in runs]
