"""Repeated byte strings, found by sorting suffixes in two stages.

A string of ``window`` bytes that starts at two places is found in three steps.

1. Which suffixes can matter. Every window picks the place of its smallest 16-byte gram, by content alone, so equal
   windows pick the same place. Neighbouring windows with one pick form a segment: a run of suffix starts, all
   of which hold some 200 bytes beside the pick. A hash of these bytes is the segment's bucket.
   Buckets are exchanged as packed numbers (``exchange``), and only those found at two places at least go on.
2. The suffixes of a bucket are sorted together: tasks take whole buckets in blocks of some megabytes, put them in
   suffix order by two-stage sorting, compute the common prefixes of neighbours (``suffixes``) and mark
   the starts that share ``window`` bytes with a neighbour. Equal segments enter as one text with a count; with
   two or more of them all their starts are repeated.
3. The marked starts come back to their documents, which lose every byte they cover.

A bucket with more than ``HOT`` different segments is not gathered in a task: its windows are compared
by 128-bit hashes in a grouped aggregation instead, with the same result.

Texts are bytes in UTF-8, a null text has none, and windows never cross texts. Rows are told apart by id and
text; repeated rows are texts of their own, so all of their windows are repeated.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbline.llm import exchange as X
from kerbline.llm.suffixes import repeated_starts
from kerbline.llm.texts import blob, pieces, row_key, utf8
from kerbline.session import materialise

WINDOW = 400
GRAM = 16
PIECE_BYTES = 3_000_000  # of texts handled together in a task
BLOCK_BYTES = 1_500_000  # of segments sorted together
HOT = 4000
PLACE = np.uint64(2**32 - 1)


def _smallest(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every run of ``width`` values, from minima of blocks' ends and beginnings."""
    n = len(values)
    rows = -(-n // width)
    padded = np.full(rows * width, np.uint64(2**64 - 1))
    padded[:n] = values
    table = padded.reshape(rows, width)
    head = np.minimum.accumulate(table, axis=1).ravel()
    tail = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(tail[: n - width + 1], head[width - 1 : n])


def segments(data: np.ndarray, offsets: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first start, number of starts, bucket, document) of the segments of texts that lie one after another."""
    none = np.zeros(0, np.int64)
    sizes = np.maximum(np.diff(offsets) - window + 1, 0)
    total = int(sizes.sum())
    if not total:
        return none, none, none.astype(np.uint64), none
    doc = np.repeat(np.arange(len(sizes)), sizes)
    start = np.arange(total) + np.repeat(offsets[:-1] - (np.cumsum(sizes) - sizes), sizes)
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    word = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    n = len(data) - GRAM + 1
    gram = X.mixed(word[:n] * np.uint64(0x9E3779B97F4A7C15) + X.mixed(word[8 : 8 + n]))
    least = _smallest(gram & ~PLACE | np.arange(n, dtype=np.uint64), window - GRAM + 1)
    pick = (least[start] & PLACE).astype(np.int64)
    half = (window - GRAM) // 2
    right = start >= pick - half
    first = np.flatnonzero(np.r_[True, (pick[1:] != pick[:-1]) | (right[1:] != right[:-1]) | (doc[1:] != doc[:-1])])
    count = np.diff(np.r_[first, total])
    pick, right = pick[first], right[first]
    a = np.where(right, pick, pick - half - 1)
    b = np.where(right, pick + window - half, pick + GRAM)
    raw, digest = memoryview(np.ascontiguousarray(data)), xxhash.xxh64_intdigest
    bucket = np.fromiter((digest(raw[i:j], r) for i, j, r in zip(a.tolist(), b.tolist(), right.tolist(), strict=True)), np.uint64, len(first))
    return start[first], count, bucket, doc[first]


def _spans(mask: np.ndarray) -> np.ndarray:
    """Begin and end of the runs of true values, in turn."""
    return np.flatnonzero(np.diff(np.r_[False, mask, False].astype(np.int8)))


class Block:
    """Segments of whole buckets, sorted together."""

    def __init__(self):
        self.buckets: dict[int, dict[bytes, list]] = {}
        self.size = 0

    def add(self, bucket: int, text: bytes, places: tuple) -> None:
        known = self.buckets.setdefault(bucket, {})
        if text not in known:
            self.size += len(text)
        known.setdefault(text, []).append(places)

    def repeated(self, window: int) -> Iterator[tuple[int, int, np.ndarray]]:
        """(id, key, spans of starts in the document) for the marked starts."""
        sorted_, lengths = [], []
        for known in self.buckets.values():
            for text, places in known.items():
                copies = sum(len(p[0]) for p in places)
                n = len(text) - window + 1
                if copies > 1:
                    yield from self._at(places, np.array([0, n]))
                if len(known) > 1:
                    sorted_.append((text, places if copies == 1 else None))
                    lengths.append(n)
        if not sorted_:
            return
        text = np.frombuffer(b"".join(t for t, _ in sorted_), np.uint8)
        begin = np.cumsum([0] + [len(t) for t, _ in sorted_])[:-1]
        lengths = np.array(lengths)
        starts = np.repeat(begin, lengths) + np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        marked = np.split(repeated_starts(text, starts, window), np.cumsum(lengths)[:-1])
        for (_, places), mask in zip(sorted_, marked, strict=True):
            if places and mask.any():
                yield from self._at(places, _spans(mask))

    @staticmethod
    def _at(places: list, spans: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
        for ids, keys, starts in places:
            for i, key, start in zip(ids.tolist(), keys.tolist(), starts.tolist(), strict=True):
                yield i, key, spans + start


SEGMENT = pa.schema([("bucket", pa.int64()), ("text", pa.binary()), ("ids", pa.binary()), ("keys", pa.binary()), ("starts", pa.binary())])
SEGMENT_SQL = "bucket long, text binary, ids binary, keys binary, starts binary"
MARKS_SQL = "id long, key long, hits binary"


def _gathered(found: Iterator[tuple[int, int, np.ndarray]]) -> pa.RecordBatch:
    by: dict[tuple[int, int], list] = {}
    for i, key, spans in found:
        by.setdefault((i, key), []).append(spans)
    return pa.record_batch({
        "id": pa.array([i for i, _ in by], pa.int64()), "key": pa.array([k for _, k in by], pa.int64()),
        "hits": pa.array([np.concatenate(s).astype("<i8").tobytes() for s in by.values()], pa.binary())})


def _cut_segments(open_: DataFrame, window: int, texts: bool) -> DataFrame:
    """The segments in repeated buckets, equal ones of a batch in one row with all their places."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p in pieces(b, PIECE_BYTES):
                data, offsets = blob(p.column("text"))
                start, count, bucket, doc = segments(data, offsets, window)
                hits = p.column("hits").to_pylist()
                ids = np.array([i or 0 for i in p.column("id").to_pylist()], "<i8")
                keys = p.column("key").to_numpy(zero_copy_only=False).astype("<i8")
                edge = np.searchsorted(doc, np.arange(len(hits) + 1))
                wanted = np.zeros(len(start), bool)
                for d, lists in enumerate(hits):
                    if lists and edge[d] < edge[d + 1]:
                        wanted[edge[d] + X.merged(lists)] = True  # segments are numbered within a text
                raw, rows = data.tobytes(), {}
                for at in np.flatnonzero(wanted).tolist():
                    s = int(start[at])
                    places = rows.setdefault((int(bucket[at]), raw[s : s + int(count[at]) - 1 + window]), ([], []))
                    places[0].append(int(doc[at]))
                    places[1].append(s - int(offsets[doc[at]]))
                signed = [k - 2**64 if k >= 2**63 else k for k, _ in rows]
                yield pa.record_batch({
                    "bucket": pa.array(signed, pa.int64()), "text": pa.array([t for _, t in rows] if texts else [b""] * len(rows), pa.binary()),
                    "ids": pa.array([ids[d].tobytes() for d, _ in rows.values()], pa.binary()), "keys": pa.array([keys[d].tobytes() for d, _ in rows.values()], pa.binary()),
                    "starts": pa.array([np.array(s, "<i8").tobytes() for _, s in rows.values()], pa.binary())}, schema=SEGMENT)

    return open_.select("id", "key", "text", "hits").mapInArrow(cut, SEGMENT_SQL)


def _sorted_marks(segs: DataFrame, window: int, parts: int) -> DataFrame:
    """Marked starts per document, from blocks of whole buckets in suffix order."""

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, last = Block(), None
        for b in batches:
            for bucket, text, ids, keys, starts in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if bucket != last and block.size >= BLOCK_BYTES:
                    yield _gathered(block.repeated(window))
                    block = Block()
                last = bucket
                block.add(bucket, text, (np.frombuffer(ids, "<i8"), np.frombuffer(keys, "<i8"), np.frombuffer(starts, "<i8")))
        yield _gathered(block.repeated(window))

    return segs.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(sort, MARKS_SQL)


def _hashed_marks(segs: DataFrame, window: int) -> DataFrame:
    """The same for buckets that no task should hold, by comparing hashes of their windows."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh64_intdigest
        for b in batches:
            for _, text, ids, keys, starts in zip(*(c.to_pylist() for c in b.columns), strict=True):
                n = len(text) - window + 1
                h1 = np.array([digest(text[i : i + window], 1) for i in range(n)], np.uint64).view(np.int64)
                h2 = np.array([digest(text[i : i + window], 2) for i in range(n)], np.uint64).view(np.int64)
                for i, key, start in zip(*(np.frombuffer(x, "<i8").tolist() for x in (ids, keys, starts)), strict=True):
                    yield pa.record_batch({"h1": pa.array(h1), "h2": pa.array(h2), "id": pa.array(np.full(n, i)), "key": pa.array(np.full(n, key)), "at": pa.array(np.arange(start, start + n))})

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield _gathered((i, key, np.array([at, at + 1])) for i, key, at in zip(*(c.to_pylist() for c in b.columns), strict=True))

    each = segs.mapInArrow(explode, "h1 long, h2 long, id long, key long, at long")
    twice = each.groupBy("h1", "h2").agg(F.count("*").alias("n")).filter("n > 1").select("h1", "h2")
    return each.join(twice, ["h1", "h2"], "left_semi").select("id", "key", "at").mapInArrow(spans, MARKS_SQL)


def remove_repeats(df: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, hot: int = HOT) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept, kept_sha256, spans) per row of ``df``.

    ``kept``: the bytes that stay; null where nothing is removed (the hash is given all the same). ``spans``:
    begin and end of the removed runs as packed 64-bit integers.
    """
    if window < 3 * GRAM:
        raise ValueError(f"window must be {3 * GRAM} bytes at least")
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.select(F.col(doc_id).cast("long").alias("id"), row_key(F.col(doc_id), F.col(text)).alias("key"), utf8(F.col(text)).alias("text"))

    def buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p in pieces(b, PIECE_BYTES):
                _, _, bucket, doc = segments(*blob(p.column("text")), window)
                edge = np.searchsorted(doc, np.arange(p.num_rows + 1))
                yield X.packed(
                    bucket, X.partition(bucket, parts), np.arange(len(bucket)), np.zeros(len(bucket), bool), edge, p.column("id").to_pylist(), p.column("key").to_pylist(),
                    parts, False)

    state = pa.schema([("id", pa.int64()), ("key", pa.int64()), ("n_bytes", pa.int64()), ("sha", pa.string()), ("text", pa.binary()), ("hits", pa.list_(pa.binary()))])

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Size and digest of every text; the text itself goes on only where there are hits."""
        for b in batches:
            for p in pieces(b, PIECE_BYTES):
                ids, keys, texts, hits = (c.to_pylist() for c in p.columns)
                open_ = [t if h else None for t, h in zip(texts, hits, strict=True)]
                yield pa.record_batch([
                    pa.array(ids, pa.int64()), pa.array(keys, pa.int64()), pa.array([len(t) for t in texts], pa.int64()),
                    pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string()), pa.array(open_, pa.binary()), pa.array(hits, pa.list_(pa.binary()))], schema=state)

    done = ["id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256", "spans"]
    kinds = [pa.int64()] * 4 + [pa.binary(), pa.string(), pa.binary()]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p in pieces(b, PIECE_BYTES):
                out = []
                for i, n, sha, t, hits in zip(*(c.to_pylist() for c in p.columns), strict=True):
                    if not hits:
                        out.append((i, n, 0, 0, None, sha, b""))
                        continue
                    marks = np.frombuffer(b"".join(hits), "<i8").reshape(-1, 2)
                    edge = np.zeros(n + 1, np.int64)
                    np.add.at(edge, marks[:, 0], 1)
                    np.add.at(edge, marks[:, 1] - 1 + window, -1)
                    gone = np.cumsum(edge[:-1]) > 0
                    kept = np.frombuffer(t, np.uint8)[~gone].tobytes()
                    spans = _spans(gone)
                    out.append((i, n, int(gone.sum()), len(spans) // 2, kept, hashlib.sha256(kept).hexdigest(), spans.astype("<i8").tobytes()))
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)] if out else [pa.array([], k) for k in kinds], names=done)

    found = X.exchanged(rows.mapInArrow(buckets, X.SENT), parts, False)
    settled = X.with_hits(rows, found).select("id", "key", "text", "hits").mapInArrow(settle, "id long, key long, n_bytes long, sha string, text binary, hits array<binary>")
    settled = materialise(settled, "bucketed")
    open_ = settled.filter(F.col("text").isNotNull())
    crowded = _cut_segments(open_, window, False).groupBy("bucket").agg(F.count("*").alias("n")).filter(F.col("n") > hot)
    crowded = materialise(crowded.select("bucket"), "crowded")
    segs = _cut_segments(open_, window, True)
    if crowded.isEmpty():
        marks = _sorted_marks(segs, window, parts)
    else:
        marks = _sorted_marks(segs.join(crowded, "bucket", "left_anti"), window, parts).union(_hashed_marks(segs.join(crowded, "bucket", "left_semi"), window))
    marks = materialise(marks.groupBy("id", "key").agg(F.collect_list("hits").alias("hits")), "marks")
    both = X.with_hits(settled.drop("hits"), marks).select("id", "n_bytes", "sha", "text", "hits")
    return both.mapInArrow(cut, "id long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string, spans binary")
