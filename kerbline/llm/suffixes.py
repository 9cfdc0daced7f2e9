"""Suffix order of a block of bytes by two-stage sorting, and the common prefixes of neighbours.

Stage one sorts directly only the suffixes that are smaller than their successors (type S). Each is read as a
sequence of short tokens that end where the next type S suffix begins; equal tokens are told apart by
doubling, up to the depth asked for. Stage two induces all other suffixes (type L) from left to right: a
finished bucket, scanned in order, puts the suffix before each of its members in its bucket. A scan of a
bucket is one vectorised step.
"""

from __future__ import annotations

import numpy as np

STEP = 7  # bytes of a token at most


def smaller_than_next(text: np.ndarray) -> np.ndarray:
    """Whether the suffix at each place is smaller than the one after it (the empty one at the end is the smallest)."""
    n = len(text)
    out = np.zeros(n, bool)
    change = np.flatnonzero(text[:-1] != text[1:])
    if len(change):
        rising = text[change] < text[change + 1]
        out[: change[-1] + 1] = np.repeat(rising, np.diff(np.r_[-1, change]))
    return out


def _tokens(text: np.ndarray, small: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where tokens begin, and a number for each: its bytes, and for equal bytes the longer token first.

    Of two suffixes with equal bytes the one whose next type S place comes later is the smaller there.
    """
    n = len(text)
    at = np.flatnonzero(small)
    gap = np.diff(np.r_[at, n])
    extra = (gap - 1) // STEP
    if extra.any():
        first = np.repeat(at, extra)
        nth = np.arange(len(first)) - np.repeat(np.cumsum(extra) - extra, extra) + 1
        at = np.sort(np.concatenate((at, first + nth * STEP)))
        gap = np.diff(np.r_[at, n])
    padded = np.concatenate((text, np.zeros(8, np.uint8)))
    value = np.zeros(len(at), np.uint64)
    for i in range(STEP):
        value = value << np.uint64(8) | padded[at + i].astype(np.uint64)
    return at, value << np.uint64(8) | (STEP - np.minimum(gap, STEP)).astype(np.uint64)


def sort_small(text: np.ndarray, small: np.ndarray, depth: int) -> np.ndarray:
    """The type S suffixes in order of their first ``depth`` bytes at least."""
    at, value = _tokens(text, small)
    m = len(at)
    order = np.argsort(value, kind="stable")
    new = np.r_[True, value[order][1:] != value[order][:-1]] if m else np.zeros(0, bool)
    rank = np.empty(m, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(m), 0))
    tied = _tied(order, new)
    reach, ends = 1, np.r_[at, len(text)]
    while len(tied):
        tied = tied[ends[np.minimum(tied + reach, m)] - at[tied] < depth]  # the rest agree far enough
        if not len(tied):
            break
        after = np.where(tied + reach < m, rank[np.minimum(tied + reach, m - 1)] + 1, 0)
        key = rank[tied] * (m + 2) + after
        by = np.argsort(key, kind="stable")
        tied, key = tied[by], key[by]
        old = rank[tied]
        fresh = np.r_[True, key[1:] != key[:-1]]
        group = np.maximum.accumulate(np.where(np.r_[True, old[1:] != old[:-1]], np.arange(len(tied)), 0))
        rank[tied] = np.maximum.accumulate(np.where(fresh, np.arange(len(tied)) - group + old, 0))
        tied = _tied(tied, fresh)
        reach *= 2
    mine = np.flatnonzero(small[at])
    return at[mine[np.argsort(rank[mine], kind="stable")]]


def _tied(order: np.ndarray, new: np.ndarray) -> np.ndarray:
    """Members of the groups that have more than one."""
    return order[~(new & np.r_[new[1:], True])] if len(order) else order


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """All suffixes in order of their first ``depth`` bytes at least (those that agree so far stay together)."""
    n = len(text)
    small = smaller_than_next(text)
    direct = sort_small(text, small, depth)
    heads = np.searchsorted(text[direct], np.arange(257))
    pending: list[list[np.ndarray]] = [[] for _ in range(256)]
    out = []
    if n:
        pending[text[n - 1]].append(np.array([n - 1]))  # before the empty suffix, the smallest of all
    for c in range(256):
        bucket = []
        wave = np.concatenate(pending[c]) if pending[c] else np.zeros(0, np.int64)
        pending[c] = []
        while len(wave):
            bucket.append(wave)
            before = wave[wave > 0] - 1
            wave = before[text[before] == c]
        bucket.append(direct[heads[c] : heads[c + 1]])
        scan = np.concatenate(bucket)
        if not len(scan):
            continue
        out.append(scan)
        before = scan[scan > 0] - 1
        letter = text[before]
        larger = letter > c
        before, letter = before[larger], letter[larger]
        if len(before):
            by = np.argsort(letter, kind="stable")
            before, letter = before[by], letter[by]
            cuts = np.flatnonzero(np.r_[True, letter[1:] != letter[:-1]])
            for a, b in zip(cuts, np.r_[cuts[1:], len(before)], strict=True):
                pending[letter[a]].append(before[a:b])
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def common_prefixes(text: np.ndarray, a: np.ndarray, b: np.ndarray, limit: int) -> np.ndarray:
    """Length of the common prefix of the suffixes ``a[i]`` and ``b[i]``, ``limit`` at most."""
    padded = np.concatenate((text, np.zeros(limit + 8, np.uint8)))
    word = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))
    room = len(text) - np.maximum(a, b)
    out = np.minimum(room, limit)
    open_ = np.arange(len(a))
    for step in range(0, limit, 8):
        differ = word[a[open_] + step] ^ word[b[open_] + step]
        ended = differ != 0
        if ended.any():
            low = differ[ended] & (~differ[ended] + np.uint64(1))  # its lowest set bit
            same = step + (np.log2(low.astype(np.float64)).astype(np.int64) >> 3)
            out[open_[ended]] = np.minimum(out[open_[ended]], same)
            open_ = open_[~ended]
        if not len(open_):
            break
    return out


def repeated_starts(text: np.ndarray, starts: np.ndarray, window: int) -> np.ndarray:
    """Which of the ``starts`` begin a run of ``window`` bytes that also begins at another of them.

    Every start must be followed by ``window`` bytes. Equal runs are neighbours in the suffix order of the starts.
    """
    wanted = np.zeros(len(text), bool)
    wanted[starts] = True
    order = suffix_order(text, window)
    order = order[wanted[order]]
    equal = common_prefixes(text, order[:-1], order[1:], window) >= window
    found = np.zeros(len(text), bool)
    found[order[:-1][equal]] = True
    found[order[1:][equal]] = True
    return found[starts]
