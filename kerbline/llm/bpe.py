"""Byte-pair encoding and decoding with an automaton compiled from the merge list.

Construction. The automaton starts as one state with a loop for every byte: every sequence of single
bytes is a tokenization under no rules. The rules are then applied in their order, each by a merge
gadget. For the rule ``u v -> w``, the state reached over an arc ``u`` loses its arc ``v`` (the pair may
no longer stand side by side), and wherever ``u`` then ``v`` could be read an arc ``w`` is added,
leading to a copy of the state after ``v``. After the last rule the accepted arc sequences are exactly the
tokenizations the rules produce, one per byte string.

All arcs with one label lead to one state, so a state is named by the token read last. A gadget copies
a state and removes an arc; storing what each gadget did (which state was copied, when, and which arc was
removed, when) describes all states without writing out tens of thousands of near-equal arc rows.
``_has`` reads an entry of the transition table from that description; entries in use are kept.

Encoding splits texts by the tokenizer's pattern and walks the words from the start state. As every beginning
of a word has one accepted path, each place is reached in one state, and the work is linear in the
word. Words are walked side by side, so a step of the table serves many at once. Decoding emits the
labels of the arcs.

Null counts as the empty text and gives no tokens. Texts of any length are encoded whole.
"""

from __future__ import annotations

import json
import pickle

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import BinaryType, StringType

from kerbline.llm.texts import hold, with_columns

# Fixed value: the word pattern of the published byte-level tokenizer.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
KEPT_WORDS = 24_000_000  # bytes of encoded words and pieces kept by a worker; past that the store is emptied and filled anew
KEPT_PIECES = 32_000_000
ENTRY = 140  # bytes of a kept word besides its letters and tokens
WALKED = 60_000  # letters of words walked side by side; the arrays of a walk take some hundred bytes for each
SLICE = 500_000  # bytes of rows encoded together
KEPT_ARCS = 240_000  # a table of half a million places
START = -1


def byte_letters() -> dict[str, int]:
    """Letters that stand for bytes in the vocabulary: printable Latin-1 stands for itself, the rest follows from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Table:
    """Whole numbers to whole numbers, looked up many at a time; grows as entries come."""

    FREE = np.int64(-1)
    SPREAD = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, bits: int = 16):
        self.clear(bits)

    def clear(self, bits: int = 16) -> None:
        self.bits, self.used = bits, 0
        self.keys, self.values = np.full(1 << bits, self.FREE), np.zeros(1 << bits, np.int32)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * self.SPREAD >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Values of the keys, -1 where there is none."""
        slot, mask = self._slot(keys), (1 << self.bits) - 1
        there = self.keys[slot]
        out = np.where(there == keys, self.values[slot], np.int32(-1))
        open_ = np.flatnonzero((there != keys) & (there != self.FREE))
        while len(open_):
            slot[open_] = slot[open_] + 1 & mask
            there = self.keys[slot[open_]]
            same = there == keys[open_]
            out[open_[same]] = self.values[slot[open_[same]]]
            open_ = open_[~same & (there != self.FREE)]
        return out

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """New keys, each once."""
        while (self.used + len(keys)) * 2 > 1 << self.bits:
            old = self.keys != self.FREE
            k, v = self.keys[old], self.values[old]
            self.clear(self.bits + 1)
            self._place(k, v)
        self._place(keys, values)

    def _place(self, keys: np.ndarray, values: np.ndarray) -> None:
        slot, mask, open_ = self._slot(keys), (1 << self.bits) - 1, np.arange(len(keys))
        while len(open_):
            free = open_[self.keys[slot[open_]] == self.FREE]
            _, first = np.unique(slot[free], return_index=True)  # of those that want one place, one gets it
            won = free[first]
            self.keys[slot[won]], self.values[slot[won]] = keys[won], values[won]
            open_ = open_[self.keys[slot[open_]] != keys[open_]]
            slot[open_] = slot[open_] + 1 & mask
        self.used += len(keys)


class Automaton:
    """Compiled from the text of a tokenizer file with byte-level BPE and one rule per merged token."""

    def __init__(self, source: str):
        spec = json.loads(source)
        vocab, letters = spec["model"]["vocab"], byte_letters()
        self.specials = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        self.labels: dict[int, bytes] = {i: bytes(letters[c] for c in t) for t, i in vocab.items() if all(c in letters for c in t)}
        self.labels |= {i: t.encode() for t, i in self.specials.items()}
        size = max(self.labels) + 1
        self.size = size
        self.born = [-1] * size  # number of the gadget that made the token's arc; -1: a byte
        self.arc_of = [0] * size  # the arc beside which it was added
        self.copy_of = [0] * size  # the state its target was copied from
        self.removed: dict[int, int] = {}  # state and arc -> number of the gadget that removed it
        if missing := [b for c, b in letters.items() if c not in vocab]:
            raise ValueError(f"bytes without a token: {missing}")
        live = {vocab[c] for c in letters}
        for rank, merge in enumerate(spec["model"]["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            u, v, w = vocab[left], vocab[right], vocab[left + right]
            self._gadget(rank, u, v, w, live)
        # the live labels as a tree: node * 256 + byte -> next node; node -> token
        tree: dict[int, int] = {}
        token = [-1]
        for t in sorted(live):
            node = 0
            for byte in self.labels[t]:
                node = tree.setdefault(node << 8 | byte, len(token))
                if node == len(token):
                    token.append(-1)
            token[node] = t
        self.token = np.array(token)
        self.next = Table()
        self.next.put(np.array(list(tree), np.int64), np.array(list(tree.values()), np.int32))
        self.arcs = Table()
        self.length = np.zeros(size, np.int64)
        for t, x in self.labels.items():
            self.length[t] = len(x)
        self._open()

    def _open(self) -> None:
        """Empty stores and the patterns."""
        self.words: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.words_size = self.pieces_size = 0
        self.split = regex.compile(PATTERN)
        self.special = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.specials, key=len, reverse=True)) + ")") if self.specials else None

    def __getstate__(self) -> dict:
        """Packed arrays only: a worker opens them without compiling anything."""
        labels = sorted(self.labels)
        return {
            "specials": self.specials, "size": self.size, "gadgets": np.array([self.born, self.arc_of, self.copy_of], np.int32),
            "removed": np.array([list(self.removed), list(self.removed.values())], np.int64), "token": self.token.astype(np.int32), "length": self.length.astype(np.int32),
            "next": (self.next.bits, self.next.used, self.next.keys, self.next.values), "label_ids": np.array(labels, np.int32), "label_text": b"".join(self.labels[i] for i in labels)}

    def __setstate__(self, state: dict) -> None:
        self.specials, self.size, self.token, self.length = (state[k] for k in ("specials", "size", "token", "length"))
        self.token, self.length = self.token.astype(np.int64), self.length.astype(np.int64)
        self.born, self.arc_of, self.copy_of = state["gadgets"].tolist()
        self.removed = dict(zip(*state["removed"].tolist(), strict=True))
        self.next = Table(1)
        self.next.bits, self.next.used, self.next.keys, self.next.values = state["next"]
        self.arcs = Table()
        ids, text = state["label_ids"], state["label_text"]
        ends = np.cumsum(self.length[ids]).tolist()
        self.labels = {i: text[a:b] for i, a, b in zip(ids.tolist(), [0, *ends], ends, strict=False)}
        self._open()

    def _gadget(self, rank: int, u: int, v: int, w: int, live: set[int]) -> None:
        if u not in live or v not in live or not self._has(u, v, rank - 1):
            return  # u then v can never be read: the rule has no effect
        if w in live:
            raise ValueError(f"token {w} is made by two rules")
        self.removed[u * self.size + v] = rank
        self.born[w], self.arc_of[w], self.copy_of[w] = rank, u, v
        live.add(w)

    def _has(self, state: int, arc: int, time: int) -> bool:
        """Whether ``state`` has ``arc`` after the gadgets up to number ``time``."""
        removed, born, size = self.removed, self.born, self.size
        while True:
            if removed.get(state * size + arc, time + 1) <= time:
                return False
            made, seen = born[arc], born[state]
            if made < 0 and seen < 0:
                return True
            if made > seen:  # the arc came to the state with a gadget, beside arc_of
                time, arc = min(time, made), self.arc_of[arc]
            else:  # the state came as a copy that had the arc or not
                time, state = min(time, seen - 1), self.copy_of[state]

    def has_arcs(self, states: np.ndarray, arcs: np.ndarray) -> np.ndarray:
        """Table entries for pairs of state and arc, filled in when first asked for."""
        keys = states * self.size + arcs
        found = self.arcs.get(keys)
        new = np.unique(keys[found < 0])
        if len(new):
            if self.arcs.used + len(new) > KEPT_ARCS:
                self.arcs.clear()
                new = np.unique(keys)
            self.arcs.put(new, np.array([self._has(*divmod(k, self.size), 1 << 60) for k in new.tolist()], np.int32))
            found = self.arcs.get(keys)
        return found > 0

    def walk(self, words: list[bytes]) -> list[bytes]:
        """The labels of the one accepted path that spells each word, as packed token numbers.

        All words are walked side by side. Every beginning of a word has exactly one accepted path too, so every place
        of a word is reached in exactly one state: the arcs that leave it are the labels that start there and that
        the state has, and each leads to the state of a later place.
        """
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        data = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        if not len(data):
            return [b""] * len(words)
        begin = np.cumsum(sizes) - sizes
        end = np.repeat(begin + sizes, sizes)
        # all labels that start at each place
        at, node, step = np.arange(len(data)), np.zeros(len(data), np.int64), 0
        starts, labels = [], []
        while len(at):
            node = self.next.get(node << 8 | data[at + step]).astype(np.int64)
            step += 1
            t = self.token[node]
            hit = (node >= 0) & (t >= 0)
            starts.append(at[hit])
            labels.append(t[hit])
            on = (node >= 0) & (at + step < end[at])
            at, node = at[on], node[on]
        start, label = np.concatenate(starts), np.concatenate(labels)
        place = start - np.repeat(begin, sizes)[start]
        by = np.argsort(place, kind="stable")
        start, label = start[by], label[by]
        cuts = np.searchsorted(place[by], np.arange(int(sizes.max(initial=0)) + 1))
        state = np.full(len(data), START)  # by the last byte read
        for a, b in zip(cuts, cuts[1:], strict=False):
            s, t = start[a:b], label[a:b]
            if a:
                there = self.has_arcs(state[s - 1], t)
                s, t = s[there], t[there]
            state[s + self.length[t] - 1] = t
        # back from the ends
        which, at, parts = np.arange(len(words)), begin + sizes, []
        at, which = at[sizes > 0], which[sizes > 0]
        count = np.zeros(len(words), np.int64)
        while len(which):
            t = state[at - 1]
            parts.append((which, t))
            count[which] += 1
            at = at - self.length[t]
            on = at > begin[which]
            at, which = at[on], which[on]
        edge = np.cumsum(count)
        ids = np.zeros(int(edge[-1]) if len(edge) else 0, "<u4")
        for back, (w, t) in enumerate(parts):
            ids[edge[w] - 1 - back] = t
        raw, edge = ids.tobytes(), (edge * 4).tolist()
        return [raw[a:b] for a, b in zip([0, *edge], edge, strict=False)]

    def _learn(self, words: set[str]) -> None:
        """Encode the words that aren't kept yet."""
        if self.words_size > KEPT_WORDS:
            self.words.clear()
            self.words_size = 0
        new = [w for w in words if w not in self.words]
        new.sort(key=len)  # words of like length walk together
        size, group = 0, []
        for w in new:
            group.append(w)
            size += len(w)
            if size > WALKED:
                self._walk(group)
                size, group = 0, []
        self._walk(group)

    def _walk(self, group: list[str]) -> None:
        self.words.update(zip(group, self.walk([w.encode("utf-8", "surrogatepass") for w in group]), strict=True))
        self.words_size += sum(ENTRY + 5 * len(w) for w in group)

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Token numbers of each text as little-endian unsigned 32-bit integers.

        The pattern always splits before a space that something other than white space follows, so texts are
        cut at spaces first: what stands between repeats a lot, and the pattern runs only on what is new.
        """
        if self.pieces_size > KEPT_PIECES:
            self.pieces.clear()
            self.pieces_size = 0
        plans, new = [self._plan(t) for t in texts], set()
        for plan in plans:
            for spaced, parts, known in plan:
                if spaced and None in known:
                    new.update(p for p, ids in zip(parts, known, strict=True) if ids is None)
        split = {p: self._spaced(p) for p in new}
        loose = {p: self.split.findall(p) for plan in plans for spaced, parts, _ in plan if spaced is False for p in parts}
        self._learn({w for ws in split.values() for w in ws} | {w for ws in loose.values() for w in ws})
        words = self.words
        for p, ws in split.items():
            self.pieces[p] = b"".join([words[w] for w in ws])
        self.pieces_size += sum(ENTRY + 5 * len(p) for p in split)
        loose = {p: b"".join([words[w] for w in ws]) for p, ws in loose.items()}
        out = []
        for plan in plans:
            ids: list[bytes] = []
            for spaced, parts, known in plan:
                if spaced and None not in known:
                    ids += known
                elif spaced is None:
                    ids.append(self.specials[parts[0]].to_bytes(4, "little"))
                else:
                    ids += map((self.pieces if spaced else loose).__getitem__, parts)
            out.append(b"".join(ids))
        return out

    def _plan(self, text: str) -> list[tuple[bool | None, list[str], list]]:
        """A text as lists of parts: True: each with a space before it; False: as they are; None: a special string.

        With the first kind, what is known of the parts' tokens.
        """
        plan = []
        for part in self.special.split(text) if self.special and self.special.search(text) else [text]:
            if part in self.specials:
                plan.append((None, [part], []))
                continue
            first, *rest = part.split(" ")
            known = list(map(self.pieces.get, rest))
            if None in known and any(ids is None and (not p or p[0].isspace()) for p, ids in zip(rest, known, strict=True)):  # spaces beside other white space
                plan.append((False, [part], []))
            else:
                plan += [(False, [first], []), (True, rest, known)]
        return plan

    def _spaced(self, piece: str) -> list[str]:
        """The words of a space and ``piece``."""
        if piece.isalpha():
            return [" " + piece]
        if piece[-1] in ".,;:!?" and piece[:-1].isalpha():
            return [" " + piece[:-1], piece[-1]]
        return self.split.findall(" " + piece)

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.labels.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


_COMPILED: dict[int, Automaton] = {}


def _automaton(source) -> Automaton:
    """One automaton per tokenizer file and Python worker."""
    if source.id not in _COMPILED:
        _COMPILED.clear()
        _COMPILED[source.id] = pickle.loads(source.value)
        hold(__name__, _COMPILED.clear)
    return _COMPILED[source.id]


class Source:
    """The automaton of a tokenizer file, compiled once and broadcast as packed arrays (their size is that of one vocabulary)."""

    def __init__(self, spark: SparkSession, path: str):
        with open(path, encoding="utf-8") as f:
            self.packed = spark.sparkContext.broadcast(pickle.dumps(Automaton(f.read()), protocol=5))
        self.id = hash(path)

    @property
    def value(self) -> bytes:
        return self.packed.value


def encode(df: DataFrame, text: str, tokenizer: Source, into: str = "ids", back: str | None = None) -> DataFrame:
    """``df`` with the token numbers of ``text``, packed as little-endian 32-bit integers.

    With ``back`` also a column with the text that these numbers decode to.
    """

    def fill(p: pa.RecordBatch) -> dict[str, list]:
        automaton = _automaton(tokenizer)
        ids = automaton.encode_all([t or "" for t in p.column(text).to_pylist()])
        return {into: ids} | ({back: list(map(automaton.decode, ids))} if back else {})

    return with_columns(df, {into: (pa.binary(), BinaryType())} | ({back: (pa.string(), StringType())} if back else {}), fill, SLICE)


def decode(df: DataFrame, ids: str, tokenizer: Source, into: str = "decoded") -> DataFrame:
    """``df`` with the text that packed token numbers stand for; null ids give the empty text."""

    def fill(p: pa.RecordBatch) -> dict[str, list]:
        automaton = _automaton(tokenizer)
        return {into: [automaton.decode(x or b"") for x in p.column(ids).to_pylist()]}

    return with_columns(df, {into: (pa.string(), StringType())}, fill)
