"""Repeated passages of words, found by fixed-block anchors.

Documents are cut into non-overlapping blocks of (window + 1) // 2 words, the index. Any window of ``window``
words holds a whole block, so a repeated window has a block that occurs again wherever the window does,
at any offset there: the blocks are probed with every rolling run of words of their length. Index and
probes travel as packed hashes (``exchange``). Where a probe hits, the window around it is extended to
all windows that contain the hit, and their full contents are compared by 64-bit hashes the same way, so
only windows that are repeated as a whole count, and their union is the maximal repeats.

Hits are kept per document as runs of places. Nothing is paired up: a passage with a million copies is
compared as one number with a million places, most of which settle in their own batch.

Words are runs of anything but ASCII white space, taken as they are. Null texts have no words. Rows are told
apart by id and text; repeated rows are documents of their own, whose windows repeat each other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbline.llm import exchange as X
from kerbline.llm.texts import pieces, row_key, utf8
from kerbline.session import materialise

WINDOW = 35
PIECE_BYTES = 6_000_000  # of texts handled together in a task


class Batch:
    """Words of some documents one after another."""

    def __init__(self, texts: list[bytes], hashes: X.WordHash):
        self.words = [t.split() for t in texts]
        self.sizes = np.array([len(w) for w in self.words], np.int64)
        self.starts = np.concatenate(([0], np.cumsum(self.sizes)))
        self.values = np.concatenate([hashes.of(w) for w in self.words] or [np.zeros(0, np.uint64)])
        self.doc = np.repeat(np.arange(len(texts)), self.sizes)

    def windows(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the windows that lie within one document, and where they start."""
        h = X.windows(self.values, length)
        at = np.flatnonzero(self.doc[: len(h)] == self.doc[length - 1 :]) if len(h) else np.zeros(0, np.int64)
        return h[at], at


def repeated_passages(df: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """(id, n_words, n_removed, kept, kept_sha256, spans) per row of ``df``.

    ``kept``: the words outside every repeated window, joined by blanks; null where nothing is removed
    (the hash is given all the same). ``spans``: the removed runs as packed pairs of word numbers.
    """
    block = (window + 1) // 2
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = df.select(F.col(doc_id).cast("long").alias("id"), row_key(F.col(doc_id), F.col(text)).alias("key"), utf8(F.col(text)).alias("text"))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = X.WordHash()
        for b in batches:
            for p in pieces(b, PIECE_BYTES):
                batch = Batch(p.column("text").to_pylist(), hashes)
                numbers, at = batch.windows(block)
                indexed = (at - batch.starts[batch.doc[at]]) % block == 0
                yield X.packed(X.shortened(numbers, parts), X.partition(numbers, parts), at, indexed, batch.starts, p.column("id").to_pylist(), p.column("key").to_pylist(), parts, True)

    def candidates(batch: Batch, hits: list) -> np.ndarray:
        """Starts of the windows that hold a hit of their document."""
        starts = []
        for i, lists in enumerate(hits):
            a, n = int(batch.starts[i]), int(batch.sizes[i])
            if lists and n >= window:
                near = X.covered(np.maximum(X.merged(lists) - (window - block), 0), window - block + 1, n)
                near[n - window + 1 :] = False
                starts.append(a + np.flatnonzero(near))
        return np.concatenate(starts or [np.zeros(0, np.int64)])

    def summary(i, key, words: list[bytes], hits, text: bytes | None) -> dict:
        return {"id": i, "key": key, "n_words": len(words), "sha": hashlib.sha256(b" ".join(words)).hexdigest(), "text": text, "hits": hits}

    state = pa.schema([("id", pa.int64()), ("key", pa.int64()), ("n_words", pa.int64()), ("sha", pa.string()), ("text", pa.binary()), ("hits", pa.list_(pa.binary()))])

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Word count and digest of every document; the text goes on only where there are hits."""
        for b in batches:
            for p in pieces(b, PIECE_BYTES):
                out = []
                for i, key, t, hits in zip(*(c.to_pylist() for c in p.columns), strict=True):
                    words = t.split()
                    open_ = bool(hits) and len(words) >= window
                    out.append(summary(i, key, words, hits if open_ else None, t if open_ else None))
                yield pa.RecordBatch.from_pylist(out, schema=state)

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = X.WordHash()
        for b in batches:
            for p in pieces(b, PIECE_BYTES):
                batch = Batch(p.column("text").to_pylist(), hashes)
                at = candidates(batch, p.column("hits").to_pylist())
                numbers = whole(batch.values, at)
                yield X.packed(numbers, X.partition(numbers, parts), at, np.zeros(len(at), bool), batch.starts, p.column("id").to_pylist(), p.column("key").to_pylist(), parts, False)

    def whole(values: np.ndarray, at: np.ndarray) -> np.ndarray:
        return X.windows(values, window)[at] if len(at) else np.zeros(0, np.uint64)

    done = pa.schema([("id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string()), ("kept_sha256", pa.string()), ("spans", pa.binary())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p in pieces(b, PIECE_BYTES):
                out = []
                for i, n, sha, t, hits in zip(*(c.to_pylist() for c in p.columns), strict=True):
                    gone = np.zeros(n, bool)
                    if hits:
                        words = t.split()
                        gone = X.covered(X.merged(hits), window, n)
                    if gone.any():
                        kept = b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g])
                        edges = np.flatnonzero(np.diff(np.r_[False, gone, False].astype(np.int8))).astype("<i4")
                        out.append((i, n, int(gone.sum()), kept.decode("utf-8", "replace"), hashlib.sha256(kept).hexdigest(), edges.tobytes()))
                    else:
                        out.append((i, n, 0, None, sha, b""))
                yield pa.RecordBatch.from_pylist([dict(zip(done.names, r, strict=True)) for r in out], schema=done)

    anchored = X.exchanged(rows.mapInArrow(probe, X.SENT), parts, True)
    settled = X.with_hits(rows, anchored).select("id", "key", "text", "hits").mapInArrow(settle, "id long, key long, n_words long, sha string, text binary, hits array<binary>")
    settled = materialise(settled, "anchored")
    open_ = settled.filter(F.col("text").isNotNull())
    repeats = materialise(X.exchanged(open_.select("id", "key", "text", "hits").mapInArrow(extend, X.SENT), parts, False), "repeats")
    both = X.with_hits(settled.drop("hits"), repeats).select("id", "n_words", "sha", "text", "hits")
    return both.mapInArrow(cut, "id long, n_words long, n_removed long, kept string, kept_sha256 string, spans binary")
