"""Token sequences of two tokenizers laid side by side, and how often their tokens meet.

A text (with a space before it) is cut into tokens by a byte-level tokenizer (A) and by a piece tokenizer (B). Where a
token of each ends, a group ends; an A and a B token are linked when their bytes overlap. The links of all documents are
counted by pair of tokens, and every document learns how its links fare.

First pass: tasks collect the distinct pairs they see with their counts, as packed runs by shard (a hash of the pair). The distinct
pairs of a shard get a minimal perfect hash, with the pairs themselves stored by slot; each run becomes a dense vector of counts
over the slots, ``FAN`` runs at a time, and vectors are summed in rounds of ``FAN``, so no task holds more than that
many. Second pass: shards are broadcast in blocks of ``BLOCK_BYTES``, documents are aligned again, and their
links looked up and verified against the stored pairs. Each block takes one step over the rows, without a shuffle. The number of distinct pairs is bounded by the
vocabularies, whatever the corpus; the highest count of each B token is one number per entry of B's vocabulary.

Texts are cut before a space that follows anything but white space: neither tokenizer has a token across such a place, so both treat what
lies between alone, and parts met before need not be cut anew. A part whose bytes one tokenizer does not give back
sends its whole text to both tokenizers. Texts that are null or empty, or whose tokens spell other bytes than the text,
have no tokens. Texts of any length are cut whole; repeated rows count each time; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbline.llm.bpe import byte_letters
from kerbline.llm.perfect import PerfectHash, mixed
from kerbline.llm.texts import hold, pieces, release_others
from kerbline.session import materialise

SHARDS = 64
FAN = 16
BLOCK_BYTES = 64_000_000  # of pairs and counts that a worker holds
PART_BYTES = 110_000_000  # of parts of texts and what is known of them, that a worker remembers
LONG = 64  # letters; longer parts are not remembered
RUN_PAIRS = 400_000  # links that a task gathers before it sorts them
SLICE = 1_500_000  # bytes of texts handled together
CHUNK = 2000  # parts given to the tokenizers together
_BYTE = re.compile(r"<0x([0-9A-F]{2})>")
_CUT = re.compile(r"(?<=\S) ")
_UNEVEN = re.compile(r"\s |\A | \Z")  # a space that follows white space or begins or ends a text


class Pair:
    """The files of both tokenizers, broadcast (two vocabularies)."""

    def __init__(self, spark: SparkSession, bytes_path: str, pieces_path: str):
        with open(bytes_path, encoding="utf-8") as a, open(pieces_path, "rb") as b:
            self.files = spark.sparkContext.broadcast((a.read(), b.read()))
        self.id = f"{bytes_path}\n{pieces_path}"


class Aligner:
    """Both tokenizers and what is known of parts of texts."""

    def __init__(self, byte_file: str, piece_file: bytes, with_groups: bool = True):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        import tokenizers

        self.a = tokenizers.Tokenizer.from_str(byte_file)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=piece_file)
        letters, spec = byte_letters(), json.loads(byte_file)
        vocab = spec["model"]["vocab"] | {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.bytes_a = [b""] * (max(vocab.values()) + 1)
        for t, i in vocab.items():
            self.bytes_a[i] = bytes(letters[c] for c in t) if all(c in letters for c in t) else t.encode()
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(m[1], 16)]) if (m := _BYTE.fullmatch(p)) else p.replace("▁", " ").encode() for p in names]
        self.with_groups = with_groups
        tables = {"a": len(self.bytes_a), "b": len(self.bytes_b)}
        self.said = {f"{t}{end}": np.array([f"{i}{end}" for i in range(n)], object) for t, n in tables.items() for end in ",|;"} if with_groups else {}
        #: whether a text may be cut before a space: no piece goes on over such a place
        self.cuts = not any(re.search("[^▁]▁", p) for p in names)
        self.width_a, self.width_b = (np.array([len(x) for x in t], np.int64) for t in (self.bytes_a, self.bytes_b))
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}  # part -> its number below
        self.number_of: list[str] = []
        self.met = np.zeros(0, np.int64)  # how often each part was met
        self.checked = self.size = 0
        self.groups: list[str] = []  # by part, a semicolon after each group
        self.figures = np.zeros((0, 4), np.int64)  # by part: tokens A, tokens B, groups, links
        self.links = np.zeros(0, np.uint64)  # of all parts, one part after another
        self.edge = np.zeros(1, np.int64)  # where each part's links begin, and their end
        self.fresh: list[tuple[np.ndarray, np.ndarray]] = []

    def tidy(self) -> None:
        """Forget the parts that were met once since the store was filled; if too many are left, all."""
        keep = np.flatnonzero(self.met > 1)
        keep = keep[[self.number.get(self.number_of[i], -1) == i for i in keep.tolist()]]
        size = self.figures[keep, 3]
        held = int(16 * size.sum()) + sum(250 + 2 * len(self.number_of[i]) for i in keep.tolist())
        names, groups = [self.number_of[i] for i in keep.tolist()], [self.groups[i] for i in keep.tolist()] if self.with_groups else []
        figures, links = self.figures[keep], self.links[_ranges(self.edge[keep], size)]
        self.clear()
        if held <= PART_BYTES // 2:
            self.number = dict(zip(names, range(len(names)), strict=True))
            self.number_of, self.groups, self.size, self.checked = names, groups, held, len(names)
            self.fresh = [(figures, links)]
            self.settle()
            self.met = np.zeros(len(names), np.int64)

    def settle(self) -> None:
        """Append what came with new parts."""
        if self.fresh:
            self.figures = np.concatenate([self.figures, *(f for f, _ in self.fresh)])
            self.links = np.concatenate([self.links, *(x for _, x in self.fresh)])
            self.edge = np.concatenate([[0], np.cumsum(self.figures[:, 3])])
            self.fresh = []

    def parts(self, text: str) -> list[str]:
        """A text with a space before it, cut before every space that follows neither white space nor the beginning."""
        if not self.cuts:
            return [text]
        return _CUT.split(text) if _UNEVEN.search(text) else text.split(" ")

    def _tokens(self, chunk: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        """The tokens of some parts, each with a space before it, and where each part's bytes end; None if other bytes come back."""
        text = " ".join(chunk)
        raw = f" {text}".encode()
        x, y = self.a.encode_batch_fast([f" {text}"], add_special_tokens=False)[0].ids, self.b.encode(text, num_threads=1)
        if b"".join(map(self.bytes_a.__getitem__, x)) != raw or b"".join(map(self.bytes_b.__getitem__, y)) != raw:
            return None
        ends = np.cumsum(np.fromiter(map(len, chunk if text.isascii() else map(str.encode, chunk)), np.int64, len(chunk)) + 1)
        return np.array(x, np.int64), np.array(y, np.int64), ends

    def _align(self, new: list[str]) -> set[str]:
        """Learn new parts; those are returned whose bytes a tokenizer doesn't give back.

        Parts are given to the tokenizers side by side, as each would be cut alone; those that end in white space one by one.
        """
        open_ended = [p for p in new if not p or p[-1].isspace()]
        if open_ended:
            apart = set(open_ended)
            new = [p for p in new if p not in apart]
        chunks = [new[i : i + CHUNK] for i in range(0, len(new), CHUNK)] + [[p] for p in open_ended]
        bad: set[str] = set()
        while chunks:
            chunk = chunks.pop()
            found = self._tokens(chunk)
            if found is not None:
                self._learn(chunk, *found)
            elif len(chunk) > 1:
                chunks += [chunk[: len(chunk) // 2], chunk[len(chunk) // 2 :]]
            else:
                bad.add(chunk[0])
        return bad

    def _learn(self, chunk: list[str], a: np.ndarray, b: np.ndarray, part_ends: np.ndarray) -> None:
        end_a, end_b = np.cumsum(self.width_a[a]), np.cumsum(self.width_b[b])
        ends = np.concatenate([end_a, end_b])
        ends.sort(kind="stable")  # merges two sorted lists
        last = np.append(ends[1:] != ends[:-1], True)
        common, ends = ends[~last], ends[last]  # a link for every stretch between two ends
        ia, ib = np.searchsorted(end_a, ends), np.searchsorted(end_b, ends)
        links = a[ia].astype(np.uint64) << np.uint64(32) | b[ib].astype(np.uint64)
        upto = lambda e: np.diff(np.searchsorted(e, part_ends, "right"), prepend=0)
        n_a, n_b, n_groups, n_links = map(upto, (end_a, end_b, common, ends))
        self.fresh.append((np.stack([n_a, n_b, n_groups, n_links], axis=1), links))
        first = len(self.number_of)
        self.number.update(zip(chunk, range(first, first + len(chunk)), strict=True))
        self.number_of += chunk
        self.size += 250 * len(chunk) + 2 * int(part_ends[-1]) + 16 * len(links)
        if self.with_groups:  # every group: its A tokens, then its B tokens
            group_a, group_b = np.searchsorted(common, end_a), np.searchsorted(common, end_b)
            out = np.empty(len(a) + len(b), object)
            last_a, last_b = common[group_a] == end_a, common[group_b] == end_b
            out[np.arange(len(a)) + np.searchsorted(group_b, group_a)] = np.where(last_a, self.said["a|"][a], self.said["a,"][a])
            out[np.arange(len(b)) + np.searchsorted(group_a, group_b, "right")] = np.where(last_b, self.said["b;"][b], self.said["b,"][b])
            words, at = out.tolist(), np.cumsum(n_a + n_b).tolist()
            self.groups += ["".join(words[x:y]) for x, y in zip([0, *at], at, strict=False)]

    def plan(self, texts: list[str | None]) -> list[np.ndarray]:
        """The numbers of each text's parts; none for texts without tokens."""
        if self.size > PART_BYTES:
            self.tidy()
        cut = [self.parts(t) if t else [] for t in texts]
        plan = [np.fromiter(map(self.number.get, parts, repeat(-1)), np.int64, len(parts)) for parts in cut]
        open_ = [(k, np.flatnonzero(numbers < 0).tolist()) for k, numbers in enumerate(plan)]
        bad = self._align(list({cut[k][i] for k, at in open_ for i in at}))
        for k, at in open_:
            new = [cut[k][i] for i in at]
            if bad and not bad.isdisjoint(new):  # the text is given to both tokenizers as a whole
                t = texts[k]
                plan[k] = np.array([] if t not in self.number and self._align([t]) else [self.number[t]], np.int64)
            elif at:
                plan[k][at] = [self.number[p] for p in new]
        self.settle()
        met = np.bincount(np.concatenate([*plan, np.zeros(0, np.int64)]), minlength=len(self.number_of))
        met[: len(self.met)] += self.met
        self.met = met
        return plan

    def forget_long(self) -> None:
        """Long parts are rarely met again."""
        for p in self.number_of[self.checked :]:
            if len(p) > LONG:
                self.number.pop(p, None)
        self.checked = len(self.number_of)


_HELD: dict[tuple[str, bool], Aligner] = {}


def _aligner(pair: Pair, with_groups: bool) -> Aligner:
    key = pair.id, with_groups
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = Aligner(*pair.files.value, with_groups)
        hold(__name__, _HELD.clear)
    return _HELD[key]


def _sliced(batches) -> Iterator[pa.RecordBatch]:
    release_others(__name__)
    for b in batches:
        yield from pieces(b, SLICE)


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All places of the ranges, one after another."""
    edge = np.cumsum(size)
    return np.arange(int(edge[-1]) if len(edge) else 0) + np.repeat(start - (edge - size), size)


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, counts added up."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(keys) else counts


def _shard(keys: np.ndarray) -> np.ndarray:
    return (mixed(keys, -1) >> np.uint64(40)).astype(np.int64) % SHARDS


def runs_of(texts: DataFrame, pair: Pair) -> DataFrame:
    """(shard, keys, counts): the distinct links that a task has seen, packed; a task gives more than one run a shard when it sees many."""

    def run(batches):
        keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

        def out():
            shard = _shard(keys)
            order = np.argsort(shard, kind="stable")
            edges = np.searchsorted(shard[order], np.arange(SHARDS + 1))
            rows = [(s, order[x:y]) for s, x, y in zip(range(SHARDS), edges, edges[1:], strict=False) if y > x]
            yield pa.record_batch(
                [pa.array([s for s, _ in rows], pa.int32()), pa.array([keys[o].tobytes() for _, o in rows], pa.binary()), pa.array([counts[o].tobytes() for _, o in rows], pa.binary())],
                names=["shard", "keys", "counts"])

        for p in _sliced(batches):
            aligner = _aligner(pair, False)
            plan = aligner.plan(p.column("text").to_pylist())
            times = np.bincount(np.concatenate(plan))  # of each part
            met = np.flatnonzero(times)
            size = aligner.figures[met, 3]
            links = aligner.links[_ranges(aligner.edge[met], size)]
            k, c = _summed(links, np.repeat(times[met], size))
            keys, counts = _summed(np.concatenate([keys, k]), np.concatenate([counts, c]))
            aligner.forget_long()
            if len(keys) > RUN_PAIRS:
                yield from out()
                keys, counts = keys[:0], counts[:0]
        if len(keys):
            yield from out()

    return texts.mapInArrow(run, "shard int, keys binary, counts binary")


def _numbers(column: pa.ChunkedArray, kind) -> list[np.ndarray]:
    return [np.frombuffer(x, kind) for x in column.to_pylist()]


def _keys_union(table: pa.Table) -> pa.Table:
    keys = np.unique(np.concatenate(_numbers(table.column("keys"), np.uint64)))
    return pa.table({"shard": table.column("shard").slice(0, 1).combine_chunks(), "part": table.column("part").slice(0, 1).combine_chunks(), "keys": pa.array([keys.tobytes()], pa.binary())})


def _hashed(table: pa.Table) -> pa.Table:
    keys = np.unique(np.concatenate(_numbers(table.column("keys"), np.uint64)))
    shape = PerfectHash(keys)
    stored = keys[shape.in_order(keys)]
    return pa.table({"shard": table.column("shard").slice(0, 1).combine_chunks(), "shape": pa.array([shape.to_bytes()], pa.binary()), "stored": pa.array([stored.tobytes()], pa.binary())})


def _dense(key, runs: pa.Table, shapes: pa.Table) -> pa.Table:
    """Up to about ``FAN`` runs as one vector of counts over the slots of their shard."""
    if not runs.num_rows:
        return pa.table({"shard": pa.array([], pa.int32()), "part": pa.array([], pa.int32()), "counts": pa.array([], pa.binary())})
    shape, stored = PerfectHash.from_bytes(shapes.column("shape")[0].as_py()), np.frombuffer(shapes.column("stored")[0].as_py(), np.uint64)
    vector = np.zeros(shape.n, np.int64)
    for keys, counts in zip(_numbers(runs.column("keys"), np.uint64), _numbers(runs.column("counts"), np.int64), strict=True):
        vector[shape.find(keys, stored)] += counts  # the keys of a run are distinct and all in the set
    return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "part": pa.array([key[1].as_py()], pa.int32()), "counts": pa.array([vector.tobytes()], pa.binary())})


def _vector_sum(table: pa.Table) -> pa.Table:
    vector = np.sum(_numbers(table.column("counts"), np.int64), axis=0)
    return pa.table({"shard": table.column("shard").slice(0, 1).combine_chunks(), "part": table.column("part").slice(0, 1).combine_chunks(), "counts": pa.array([vector.tobytes()], pa.binary())})


def pair_counts(texts: DataFrame, pair: Pair) -> tuple[DataFrame, DataFrame]:
    """(shard, shape, stored, counts): every link of the corpus and its count; and (b, best): the highest count of each B token."""
    runs = materialise(runs_of(texts, pair).withColumn("run", F.xxhash64("keys", "counts")), "runs")
    most = runs.groupBy("shard").count().agg(F.coalesce(F.max("count"), F.lit(0)).alias("n")).first()["n"]
    parts = first = max(1, -(-most // FAN))
    dealt = F.pmod(F.col("run"), F.lit(first)).cast("int")
    keys = runs.select("shard", dealt.alias("part"), "keys")
    while parts > 1:
        keys = keys.groupBy("shard", "part").applyInArrow(_keys_union, "shard int, part int, keys binary")
        parts = -(-parts // FAN)
        keys = keys.withColumn("part", F.pmod("part", F.lit(parts)).cast("int"))
    shapes = materialise(keys.groupBy("shard").applyInArrow(_hashed, "shard int, shape binary, stored binary"), "shapes")
    wide = shapes.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(first - 1))))
    vectors = runs.withColumn("part", dealt).groupBy("shard", "part").cogroup(wide.groupBy("shard", "part")).applyInArrow(_dense, "shard int, part int, counts binary")
    parts = first
    while parts > 1:
        parts = -(-parts // FAN)
        vectors = vectors.withColumn("part", F.pmod("part", F.lit(parts)).cast("int")).groupBy("shard", "part").applyInArrow(_vector_sum, "shard int, part int, counts binary")
    table = materialise(shapes.join(vectors.select("shard", "counts"), "shard"), "pairs")

    def tops(batches):
        for batch in batches:
            for stored, counts in zip(batch.column("stored").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                b, n = (np.frombuffer(stored, np.uint64) & np.uint64(0xFFFFFFFF)).astype(np.int64), np.frombuffer(counts, np.int64)
                best = np.zeros(int(b.max()) + 1, np.int64)
                np.maximum.at(best, b, n)
                has = np.flatnonzero(best)
                yield pa.record_batch([pa.array(has), pa.array(best[has])], names=["b", "best"])

    return table, table.select("stored", "counts").mapInArrow(tops, "b long, best long").groupBy("b").agg(F.max("best").alias("best"))


class Block:
    """Some shards of counted pairs, as a worker reads them."""

    def __init__(self, rows):
        self.shards = {s: (PerfectHash.from_bytes(shape), np.frombuffer(stored, np.uint64), np.frombuffer(counts, np.int64)) for s, shape, stored, counts in rows}

    def counts(self, links: np.ndarray) -> np.ndarray:
        """Count of each link, 0 for those of other blocks."""
        out, shard = np.zeros(len(links), np.int64), _shard(links)
        for s, (shape, stored, counts) in self.shards.items():
            of = np.flatnonzero(shard == s)
            at = shape.find(links[of], stored)
            out[of[at >= 0]] = counts[at[at >= 0]]
        return out


FIGURES = "n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def align(df: DataFrame, pair: Pair, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    ``n_best`` counts the links that are the most frequent ones of their B token in the corpus, ``count_sum`` adds up
    the counts of all links. Other columns of ``df`` are not read.
    """
    texts = df.select(F.col(text).alias("text"))
    table, top = pair_counts(texts, pair)
    best = np.zeros(1, np.int64)
    rows = top.collect()  # at most one a token of B's vocabulary
    if rows:
        best = np.zeros(max(r["b"] for r in rows) + 1, np.int64)
        best[[r["b"] for r in rows]] = [r["best"] for r in rows]
    spark = df.sparkSession
    best = spark.sparkContext.broadcast(best)
    sizes = {r["shard"]: r["n"] for r in table.select("shard", (F.octet_length("shape") + F.octet_length("stored") + F.octet_length("counts")).alias("n")).collect()}
    blocks, room = [[]], BLOCK_BYTES
    for s in sorted(sizes):
        if blocks[-1] and sizes[s] > room:
            blocks.append([])
            room = BLOCK_BYTES
        blocks[-1].append(s)
        room -= sizes[s]
    id_type = df.schema[doc_id].dataType.simpleString()
    out = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    figures = FIGURES.split(", ")
    for k, block in enumerate(blocks):
        rows = table.filter(F.col("shard").isin(block)).collect() if block else []
        shards = spark.sparkContext.broadcast([(r["shard"], bytes(r["shape"]), bytes(r["stored"]), bytes(r["counts"])) for r in rows])
        first, last = k == 0, k == len(blocks) - 1
        schema = ", ".join([f"doc_id {id_type}", *([] if last else ["text string"]), *figures])
        out = out.mapInArrow(_look_up(pair, shards, best, first, last), schema)
    return out


def _look_up(pair: Pair, shards, best, first: bool, last: bool):
    """Task function: the figures of each text with the counts of one block of pairs; later blocks add theirs."""

    def run(batches):
        block = Block(shards.value)
        top = best.value
        known, n_best, total = None, np.zeros(0, np.int64), np.zeros(0, np.int64)  # of the parts of ``known``
        for p in _sliced(batches):
            aligner = _aligner(pair, first)
            plan = aligner.plan(p.column("text").to_pylist())
            if known is not aligner.number:
                known, n_best, total = aligner.number, n_best[:0], total[:0]
            new = len(aligner.figures) - len(n_best)
            if new:
                edge = aligner.edge[len(n_best) :]
                links = aligner.links[edge[0] : edge[-1]]
                counts = block.counts(links)
                b = (links & np.uint64(0xFFFFFFFF)).astype(np.int64)
                is_best = (counts > 0) & (counts == top[np.minimum(b, len(top) - 1)])
                at = edge[:-1] - edge[0]
                n_best = np.concatenate([n_best, np.add.reduceat(is_best.astype(np.int64), at)])
                total = np.concatenate([total, np.add.reduceat(counts, at)])
            sizes = np.array([len(x) for x in plan])
            of, doc = np.concatenate([*plan, np.zeros(0, np.int64)]).astype(np.int64), np.repeat(np.arange(len(plan)), sizes)

            def summed(values: np.ndarray) -> np.ndarray:
                out = np.zeros(len(plan), np.int64)
                np.add.at(out, doc, values[of])
                return out

            columns = {"n_best": summed(n_best), "count_sum": summed(total)}
            if first:
                columns |= {n: summed(aligner.figures[:, i]) for i, n in enumerate(("n_a", "n_b", "n_groups", "n_links"))}
                groups = aligner.groups
                columns["groups_sha256"] = [hashlib.sha256("".join(map(groups.__getitem__, x.tolist()))[:-1].encode()).hexdigest() if len(x) else "" for x in plan]
            else:
                columns = {n: p.column(n).to_numpy() + v for n, v in columns.items()}
                columns |= {n: p.column(n) for n in ("n_a", "n_b", "n_groups", "n_links", "groups_sha256")}
            have = {"doc_id": p.column("doc_id"), "text": p.column("text")} | {n: v if isinstance(v, pa.Array) else pa.array(v) for n, v in columns.items()}
            names = ["doc_id", *([] if last else ["text"]), *(x.split(" ")[0] for x in FIGURES.split(", "))]
            yield pa.record_batch([have[n] for n in names], names=names)
            aligner.forget_long()

    return run
