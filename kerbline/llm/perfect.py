"""Minimal perfect hashing of a fixed set of 64-bit keys, in numpy.

Keys are thrown on a bit array twice their number; those alone on their bit stay there, the others are
thrown again with another mix, level by level. The number of set bits before a key's bit is its slot, so n keys
fill the slots 0 to n - 1. Some 3.3 bits a key are needed. A key outside the set either falls on no set bit
or is given some slot: whoever looks keys up compares the key stored at the slot.
"""

from __future__ import annotations

import pickle

import numpy as np

LEVELS = 48  # what is left after so many throws (never seen; the chance halves with each) is kept as a sorted list
_STEP, _MIX1, _MIX2 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def mixed(keys: np.ndarray, level: int) -> np.ndarray:
    """An even 64-bit hash of the keys, another for each level."""
    with np.errstate(over="ignore"):
        x = keys + _STEP * np.uint64(level + 1)
        x = (x ^ x >> np.uint64(30)) * _MIX1
        x = (x ^ x >> np.uint64(27)) * _MIX2
    return x ^ x >> np.uint64(31)


def _places(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    return ((mixed(keys, level) >> np.uint64(32)) * np.uint64(size) >> np.uint64(32)).astype(np.int64)


class PerfectHash:
    """Distinct keys (uint64) to slots."""

    def __init__(self, keys: np.ndarray):
        self.n, self.levels, base = len(keys), [], 0
        left = keys.astype(np.uint64)
        for level in range(LEVELS):
            if not len(left):
                break
            size = -(-2 * len(left) // 64) * 64
            at = _places(left, level, size)
            alone = np.bincount(at, minlength=size) == 1
            words = np.packbits(alone, bitorder="little").view(np.uint64)
            before = base + np.cumsum(np.bitwise_count(words), dtype=np.int64) - np.bitwise_count(words)
            self.levels.append((size, words, before))
            base += int(alone.sum())
            left = left[~alone[at]]
        self.rest = np.sort(left)
        if len(np.unique(left)) != len(left):
            raise ValueError("keys are not distinct")

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; -1 for some keys outside the set, any slot for others."""
        keys = keys.astype(np.uint64)
        out, open_ = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, (size, words, before) in enumerate(self.levels):
            if not len(open_):
                break
            at = _places(keys[open_], level, size)
            word, bit = words[at >> 6], (at & 63).astype(np.uint64)
            here = (word >> bit & np.uint64(1)).astype(bool)
            below = np.bitwise_count(word[here] & ((np.uint64(1) << bit[here]) - np.uint64(1)))
            out[open_[here]] = before[at[here] >> 6] + below
            open_ = open_[~here]
        if len(open_) and len(self.rest):
            at = np.minimum(np.searchsorted(self.rest, keys[open_]), len(self.rest) - 1)
            there = self.rest[at] == keys[open_]
            out[open_[there]] = self.n - len(self.rest) + at[there]
        return out

    def find(self, keys: np.ndarray, stored: np.ndarray) -> np.ndarray:
        """Slots of the keys that are in the set, by the keys ``stored`` at the slots; -1 for the others."""
        at = self.slots(keys)
        if not self.n:
            return at
        return np.where((at >= 0) & (stored[np.maximum(at, 0)] == keys), at, -1)

    def in_order(self, keys: np.ndarray) -> np.ndarray:
        """Where in ``keys`` (the set itself, in any order) the key of each slot stands."""
        order = np.empty(self.n, np.int64)
        order[self.slots(keys)] = np.arange(self.n)
        return order

    def to_bytes(self) -> bytes:
        return pickle.dumps((self.n, self.levels, self.rest), protocol=5)

    @classmethod
    def from_bytes(cls, raw: bytes) -> PerfectHash:
        out = cls.__new__(cls)
        out.n, out.levels, out.rest = pickle.loads(raw)
        return out
