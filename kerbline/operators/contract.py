"""Contraction of an edge table inside tasks, before its components are found over all of them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

CHUNK = 500_000  # edges that a task contracts at once


def _stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every vertex of the edges but the smallest of its component, with that one."""
    names, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(names))
    while True:
        low = np.minimum(label[i], label[j])
        after = label.copy()
        for at in (i, j, label[i], label[j]):
            np.minimum.at(after, at, low)
        after = after[after]
        if (after == label).all():
            break
        label = after
    leaf = label != np.arange(len(names))
    return names[leaf], names[label[leaf]]


def contracted(edges: DataFrame, chunk: int = CHUNK, by_range: bool = False) -> DataFrame:
    """Edges (a, b: long) with the components of ``edges``, in which the edges that meet in a task form stars.

    No more edges than before; a search for components then needs rounds only for paths that run through several tasks.
    ``by_range`` deals neighbouring numbers to one task, which suits nodes numbered along the streets.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def star() -> pa.RecordBatch:
            both = np.concatenate(held, axis=1)
            held.clear()
            return pa.record_batch([pa.array(x) for x in _stars(both[0], both[1])], names=["a", "b"])

        n = 0
        for batch in batches:
            held.append(np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("a", "b")]))
            n += batch.num_rows
            if n >= chunk:
                yield star()
                n = 0
        if n:
            yield star()

    ends = edges.select("a", "b")
    return (ends.repartitionByRange("a") if by_range else ends.repartition("a")).mapInArrow(run, "a long, b long")
