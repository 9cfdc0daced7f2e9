"""Small helpers shared by the text operators."""

from __future__ import annotations

import ctypes
import gc
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType

SLICE_BYTES = 2_000_000  # of rows that Python handles together


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def held_out(doc_id: Column) -> Column:
    """True for the third of the documents that no model may learn from; a null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def utf8(text: Column) -> Column:
    """The UTF-8 bytes of a text; null counts as the empty text."""
    return F.coalesce(text, F.lit("")).cast("binary")


def row_key(doc_id: Column, text: Column) -> Column:
    """A 64-bit name of a row made from its id and text; used together with the id itself."""
    return F.xxhash64(doc_id, F.coalesce(text, F.lit("")))


def blob(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a binary Arrow array and the offsets of its values, without copying."""
    width = np.int64 if pa.types.is_large_binary(array.type) or pa.types.is_large_string(array.type) else np.int32
    offsets = np.frombuffer(array.buffers()[1], width, len(array) + 1, array.offset * np.dtype(width).itemsize).astype(np.int64)
    data = np.frombuffer(array.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def pieces(batch: pa.RecordBatch, most: int):
    """A record batch in slices, none much larger than ``most`` bytes on average (a single row may be)."""
    per_row = max(1, batch.nbytes // max(1, batch.num_rows))
    step = min(max(1, most // per_row), 60_000)
    for start in range(0, batch.num_rows, step):
        yield batch.slice(start, step)


def hash_below(hashed: Column | str, fraction: Column) -> Column:
    """Whether a 64-bit hash, read as a fraction of its range, is below ``fraction``: draws the same rows on every run."""
    return (F.col(hashed) if isinstance(hashed, str) else hashed) / F.lit(2.0**64) + F.lit(0.5) < fraction


_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None) if os.name == "posix" else None  # gives freed memory back to the system, where C has it
_HELD: dict = {}  # in a Python worker: what an operator keeps for its next task, and how to drop it


def hold(owner: str, forget) -> None:
    _HELD[owner] = forget


def release_others(owner: str) -> None:
    """Drop what other operators keep in this Python worker, which lives on through the stages of a job, and give free memory back."""
    others = [n for n in _HELD if n != owner]
    for name in others:
        _HELD.pop(name)()
    if others:
        gc.collect()
    pa.default_memory_pool().release_unused()
    if others and _TRIM:
        _TRIM(0)


def released(owner: str, run):
    """A task function over record batches that first drops what other operators keep."""

    def task(batches):
        release_others(owner)
        yield from run(batches)

    return task


def with_columns(df: DataFrame, columns: dict[str, tuple[pa.DataType, DataType]], fill, most: int = SLICE_BYTES) -> DataFrame:
    """``df`` with columns that ``fill`` computes from slices of its record batches, each of about ``most`` bytes; no shuffle.

    ``fill``: record batch -> lists of values by column. Rows pass through Arrow as they are; neither side
    holds more than a batch of them.
    """
    schema = StructType([f for f in df.schema.fields if f.name not in columns])
    for name, (_, kind) in columns.items():
        schema = schema.add(name, kind)
    names, owner = schema.names, fill.__module__

    def run(batches):
        release_others(owner)
        for b in batches:
            p = have = None
            for p in pieces(b, most):
                have = {n: p.column(n) for n in p.schema.names} | {n: pa.array(v, columns[n][0]) for n, v in fill(p).items()}
                yield pa.record_batch([have[n] for n in names], names=names)
            del b, p, have
            pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, schema)


def keep_rows(df: DataFrame, wanted) -> DataFrame:
    """The rows of ``df`` for which ``wanted`` (record batch -> list of bool) says so; no shuffle."""

    owner = wanted.__module__

    def run(batches):
        release_others(owner)
        for b in batches:
            for p in pieces(b, SLICE_BYTES):
                yield p.filter(pa.array(wanted(p), pa.bool_()))

    return df.mapInArrow(run, df.schema)
