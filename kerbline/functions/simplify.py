"""Douglas–Peucker simplification, one line per row in Arrow batches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

LINE = ArrayType(StructType([StructField("x", DoubleType()), StructField("y", DoubleType())]))


def kept_vertices(xy: np.ndarray, tolerance: float) -> np.ndarray:
    """Mask of the vertices that stay: those farther than ``tolerance`` from the chord of their span."""
    keep = np.zeros(len(xy), dtype=bool)
    keep[[0, -1]] = True
    spans = [(0, len(xy) - 1)]
    while spans:
        a, b = spans.pop()
        if b - a < 2:
            continue
        chord, inner = xy[b] - xy[a], xy[a + 1 : b] - xy[a]
        size = float(chord @ chord)
        t = np.clip(inner @ chord / size, 0.0, 1.0) if size > 0 else np.zeros(len(inner))
        off = np.hypot(*(inner - t[:, None] * chord).T)
        far = int(off.argmax())
        if off[far] > tolerance:
            keep[a + 1 + far] = True
            spans += [(a, a + 1 + far), (a + 1 + far, b)]
    return keep


@F.pandas_udf(LINE)
def simplify_line(lines: pd.Series, tolerance: pd.Series) -> pd.Series:
    """Simplified copy of each line; lines of up to two vertices are unchanged."""

    def one(line, tol):
        if line is None or len(line) <= 2:
            return line
        xy = np.array([(p["x"], p["y"]) for p in line], dtype=float)
        return [p for p, k in zip(line, kept_vertices(xy, tol)) if k]

    return pd.Series([one(line, tol) for line, tol in zip(lines, tolerance)])
