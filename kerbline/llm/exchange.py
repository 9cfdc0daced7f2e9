"""Finding equal windows across a corpus by exchanging packed hashes.

Every window of a document has a number (a rolling hash). The numbers of a batch of documents are sorted
and sent to partitions by their value, as packed blocks of a few bytes a window instead of rows. A
partition learns which numbers occur at two places at least, and answers each batch with the places that
matter, as runs. Such an answer is small where passages repeat as a whole.

Numbers that a batch already sees twice are settled there: the batch sends one entry to inform the others and
needs no answer, so a passage with any number of copies is a few entries per batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
MANY, INDEXED, ANSWER = 1, 2, 4  # marks of an entry: occurs twice; one of its places is an indexed block; its document waits for an answer


class WordHash(dict):
    """64-bit hashes of words, kept for the words seen last."""

    KEPT = 400_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.KEPT:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def inverse(base: np.uint64) -> np.uint64:
    return np.uint64(pow(int(base), -1, 2**64))


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def windows(values: np.ndarray, length: int, base: np.uint64 = BASE) -> np.ndarray:
    """A hash of every run of ``length`` values."""
    n = len(values)
    if n < length:
        return np.zeros(0, np.uint64)
    up = powers(base, n)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values * up)))
    down = powers(inverse(base), n - length + 1)
    return mixed((sums[length:] - sums[:-length]) * down)


def pack(numbers: np.ndarray, at: np.ndarray, marks: np.ndarray) -> bytes:
    """Sorted 64-bit numbers with their places in the batch and marks, byte plane by byte plane."""
    steps = np.diff(numbers, prepend=np.uint64(0))
    planes = [np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T), np.ascontiguousarray(at.astype("<u4").view(np.uint8).reshape(-1, 4).T), marks.astype(np.uint8)]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(p.tobytes() for p in planes))


def unpack(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    n = len(raw) // 13
    numbers = np.cumsum(np.ascontiguousarray(raw[: 8 * n].reshape(8, n).T).view("<u8").ravel())
    return numbers, np.ascontiguousarray(raw[8 * n : 12 * n].reshape(4, n).T).view("<u4").ravel(), raw[12 * n :]


def spans_of(at: np.ndarray) -> np.ndarray:
    """Sorted places as runs: begin and end in turn."""
    if not len(at):
        return np.zeros(0, np.int64)
    cut = np.flatnonzero(np.diff(at) != 1)
    return np.column_stack((np.r_[at[0], at[cut + 1]], np.r_[at[cut], at[-1]] + 1)).ravel()


def places_of(spans: np.ndarray) -> np.ndarray:
    begin, size = spans[::2], spans[1::2] - spans[::2]
    return np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


SENT = "part int, batch long, entries binary, ids binary, keys binary, starts binary"
SENT_ARROW = pa.schema([("part", pa.int32()), ("batch", pa.int64()), ("entries", pa.binary()), ("ids", pa.binary()), ("keys", pa.binary()), ("starts", pa.binary())])
BACK = "batch long, kind int, ids binary, keys binary, starts binary, spans binary"
BACK_ARROW = pa.schema([("batch", pa.int64()), ("kind", pa.int32()), ("ids", pa.binary()), ("keys", pa.binary()), ("starts", pa.binary()), ("spans", pa.binary())])
SETTLED, NAMES = -1, -2  # parts of blocks that no partition has to look at


def partition(h: np.ndarray, parts: int) -> np.ndarray:
    """Where a hash goes: by its upper half."""
    return ((h >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)


def shortened(h: np.ndarray, parts: int) -> np.ndarray:
    """A hash as its partition and its lower 32 bits, so that sorted numbers of a partition lie close together.

    Different hashes may meet in one number; whoever uses these checks the windows again.
    """
    return partition(h, parts) << np.uint64(32) | h & np.uint64(2**32 - 1)


def send(numbers: np.ndarray, part: np.ndarray, at: np.ndarray, indexed: np.ndarray, parts: int, need_index: bool) -> Iterator[tuple[int, bytes]]:
    """(partition, packed entries) for a batch; also (SETTLED, spans of places) with what the batch has settled itself.

    ``numbers``: one per window; ``part``: where they go; ``at``: their places in the batch; ``indexed``: whether the window
    is one that others look for. A window matters if its number occurs twice and, with ``need_index``, one
    of these places is indexed.
    """
    order = np.argsort(numbers, kind="stable")
    numbers, part, at, indexed = numbers[order], part[order].astype(np.int64), at[order], indexed[order]
    if not len(numbers):
        return
    new = np.r_[True, numbers[1:] != numbers[:-1]]
    first = np.flatnonzero(new)
    which = np.cumsum(new) - 1
    many = np.diff(np.r_[first, len(numbers)]) > 1
    known = np.logical_or.reduceat(indexed, first)
    settled = many & (known if need_index else True)
    mine = settled[which]
    if mine.any():
        yield SETTLED, spans_of(np.sort(at[mine])).astype("<i4").tobytes()
    out = ~mine | (new & mine)
    marks = (many[which] * MANY + known[which] * INDEXED + ~mine * ANSWER)[out].astype(np.uint8)
    numbers, part, at = numbers[out], part[out], at[out]
    order = np.argsort(part, kind="stable")
    cuts = np.searchsorted(part[order], np.arange(parts + 1))
    for p in np.flatnonzero(np.diff(cuts)):
        mine = order[cuts[p] : cuts[p + 1]]
        yield int(p), pack(numbers[mine], at[mine], marks[mine])


def answers(blocks: list[tuple[np.ndarray, np.ndarray, np.ndarray]], need_index: bool) -> Iterator[tuple[int, np.ndarray]]:
    """For each unpacked block of a partition: its number and the places, in order, of its windows that matter."""
    everything = np.concatenate([e[0] for e in blocks])
    marks = np.concatenate([e[2] for e in blocks])
    order = np.argsort(everything, kind="stable")
    numbers = everything[order]
    first = np.flatnonzero(np.r_[True, numbers[1:] != numbers[:-1]])
    seen = np.bitwise_or.reduceat(marks[order], first)
    many = (np.diff(np.r_[first, len(numbers)]) > 1) | (seen & MANY > 0)
    if need_index:
        many &= seen & INDEXED > 0
    matters = numbers[first[many]]
    del everything, marks, order, numbers
    for i, (own, at, mark) in enumerate(blocks):
        hit = member(own, matters) & (mark & ANSWER > 0)
        if hit.any():
            yield i, np.sort(at[hit])


def packed(numbers: np.ndarray, place: np.ndarray, at: np.ndarray, indexed: np.ndarray, starts: np.ndarray, ids: list, keys: list, parts: int, need_index: bool) -> pa.RecordBatch:
    """What ``send`` gives, as rows, and one row with the documents of the batch: id (0 for null), row key, first place.

    A batch is known by a hash of these names, so its blocks need not repeat them.
    """
    ids, keys = np.array([i if i is not None else 0 for i in ids], "<i8").tobytes(), np.array(keys, "<i8").tobytes()
    batch = xxhash.xxh64_intdigest(ids + keys) - 2**63
    blocks = list(send(numbers, place, at, indexed, parts, need_index))
    if blocks:
        blocks.append((NAMES, None))
    names = [p == NAMES for p, _ in blocks]
    starts = starts.astype("<i8").tobytes()
    return pa.record_batch({
        "part": [p for p, _ in blocks], "batch": [batch] * len(blocks), "entries": [e for _, e in blocks],
        "ids": [ids if n else None for n in names], "keys": [keys if n else None for n in names], "starts": [starts if n else None for n in names]}, schema=SENT_ARROW)


def _answer(batches: Iterator[pa.RecordBatch], need_index: bool) -> Iterator[pa.RecordBatch]:
    """Answers to the packed blocks of a partition: settled ones and names as they come, the rest when all are known."""
    own: dict[int, list] = {}

    def row(batch: int, kind: int, ids=None, keys=None, starts=None, spans=None) -> pa.RecordBatch:
        return pa.record_batch({"batch": [batch], "kind": [kind], "ids": [ids], "keys": [keys], "starts": [starts], "spans": [spans]}, schema=BACK_ARROW)

    for b in batches:
        for part, batch, entries, ids, keys, starts in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if part == NAMES:
                yield row(batch, 0, ids, keys, starts)
            elif part == SETTLED:
                yield row(batch, 1, spans=entries)
            else:
                own.setdefault(part, []).append((batch, unpack(entries)))
    for part in sorted(own):
        blocks = own.pop(part)
        for i, at in answers([e for _, e in blocks], need_index):
            yield row(blocks[i][0], 1, spans=spans_of(at.astype(np.int64)).astype("<i4").tobytes())


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, key, hits), one row per document, from rows sorted by batch, names before answers; hits: spans of places."""
    names, known, spans = None, None, []

    def rows() -> Iterator[pa.RecordBatch]:
        if not spans:
            return
        at = np.unique(np.concatenate([places_of(np.frombuffer(x, "<i4").astype(np.int64)) for x in spans]))
        doc = np.searchsorted(names[2], at, side="right") - 1
        first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
        cut = np.split(at - names[2][doc], first[1:])
        doc = doc[first]
        yield pa.record_batch({
            "id": pa.array(names[0][doc]), "key": pa.array(names[1][doc]), "hits": pa.array([spans_of(x).astype("<i4").tobytes() for x in cut], pa.binary())})

    for b in batches:
        for batch, kind, ids, keys, starts, answer in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if kind == 0:
                yield from rows()
                known, names, spans = batch, (np.frombuffer(ids, "<i8"), np.frombuffer(keys, "<i8"), np.frombuffer(starts, "<i8")), []
            elif batch == known:
                spans.append(answer)
            else:
                raise RuntimeError("answers without the names of their batch")
    yield from rows()


def exchanged(sent: DataFrame, parts: int, need_index: bool) -> DataFrame:
    """(id, key, hits: list of binary) per document with hits."""
    place = F.when(F.col("part") < 0, F.pmod(F.xxhash64("batch"), F.lit(parts)).cast("int")).otherwise(F.col("part"))
    dealt = sent.repartitionById(parts, place)
    back = dealt.mapInArrow(lambda it: _answer(it, need_index), BACK).repartition(parts, "batch").sortWithinPartitions("batch", "kind")
    return back.mapInArrow(_named, "id long, key long, hits binary").groupBy("id", "key").agg(F.collect_list("hits").alias("hits"))


def merged(lists: list | None) -> np.ndarray:
    """The places in a document's hits, each once, in order."""
    return np.unique(places_of(np.frombuffer(b"".join(lists or []), "<i4").astype(np.int64)))


def member(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(values), bool)
    at = np.searchsorted(known, values)
    return known[np.minimum(at, len(known) - 1)] == values


def covered(starts: np.ndarray, length: int, n: int) -> np.ndarray:
    """Which of ``n`` places lie in a run of ``length`` from one of the starts."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + length, -1)
    return np.cumsum(edge[:-1]) > 0


def with_hits(rows: DataFrame, hits: DataFrame) -> DataFrame:
    """``rows`` (id, key, ...) with the hits of each, null without any."""
    hits = hits.select(F.col("id").alias("h_id"), F.col("key").alias("h_key"), "hits")
    return rows.join(hits, (F.coalesce("id", F.lit(0)) == F.col("h_id")) & (F.col("key") == F.col("h_key")), "left").drop("h_id", "h_key")
