"""Benchmark passages in documents, allowing for edits.

A test item of m characters is looked for with at most k = m * ``error_rate`` edits. It is cut into k + 1
pieces: k edits leave at least one piece untouched, so every occurrence shows up as an exact hit of some
piece. One automaton finds the hits of all pieces in a single pass over a text; around each hit Myers'
bit-parallel recurrence gives the smallest edit distance of the item to any substring. Hits that lie
close to each other are verified together, so repeats of a piece cost time in proportion to the text.

Letters are compared in lower case and all white space alike; positions are code points of the text.
Items are sent to the executors in blocks of a fixed size, each block scanning all documents.

Null or empty texts have no passages. Items shorter than ``MIN_CHARS`` are looked for with ``short``, and then only
where no letter or digit continues them, as they would be found inside other words everywhere; blank ones
never are. Repeated rows on either side give a result each.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbline.llm.texts import keep_rows

ERROR_RATE = 0.05
MIN_CHARS = 24
BLOCK_CHARS = 4_000_000  # of items sent to the executors at a time
BLANK = re.compile(r"\s")


def level(text: str) -> str:
    """Lower case and plain blanks, character by character, so that positions stay."""
    low = text.lower()
    if len(low) != len(text):
        low = "".join(x if len(x := c.lower()) == 1 else c for c in text)
    return BLANK.sub(" ", low)


def closest(pattern: dict[str, int], m: int, text: str, start: int, end: int) -> tuple[int, int]:
    """Smallest edit distance of a pattern to a substring of ``text[start:end]`` and where the first such one ends.

    ``pattern``: for each letter the bits of its places in a pattern of ``m`` letters.
    """
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, distance, best, at = full, 0, m, m, start
    get = pattern.get
    for i in range(start, end):
        eq = get(text[i], 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        up = minus | ~(xh | plus) & full
        down = plus & xh
        if up & top:
            distance += 1
        elif down & top:
            distance -= 1
        up = up << 1 & full
        down = down << 1 & full
        plus = down | ~(xv | up) & full
        minus = up & xv
        if distance < best:
            best, at = distance, i + 1
    return best, at


def ends(pattern: dict[str, int], m: int, k: int, text: str, start: int, end: int) -> Iterator[tuple[int, int]]:
    """(distance, end) wherever a substring of ``text[start:end]`` ends within ``k`` edits of a pattern; as ``closest``."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, distance = full, 0, m
    get = pattern.get
    for i in range(start, end):
        eq = get(text[i], 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        up = minus | ~(xh | plus) & full
        down = plus & xh
        if up & top:
            distance += 1
        elif down & top:
            distance -= 1
        up = up << 1 & full
        down = down << 1 & full
        plus = down | ~(xv | up) & full
        minus = up & xv
        if distance <= k:
            yield distance, i + 1


def _regions(forward: dict[str, int], backward: dict[str, int], m: int, k: int, text: str, start: int, end: int) -> Iterator[tuple[int, int, int]]:
    """(distance, start, end) of the separate occurrences in ``text[start:end]``, from its left; of overlapping ones the closest."""
    free = start

    def region(distance: int, stop: int) -> tuple[int, int, int] | None:
        first = max(free, stop - m - k)
        near, length = closest(backward, m, text[first:stop][::-1], 0, stop - first)
        return (near, stop - length, stop) if near <= k else None  # more than before where the last region takes a part

    best = None
    for distance, stop in ends(forward, m, k, text, start, end):
        if best and stop - best[1] >= m - k and (found := region(*best)):
            yield found
            free, best = found[2], None
        elif best and stop - best[1] >= m - k:
            best = None
        if best is None or distance < best[0]:
            best = distance, stop
    if best and (found := region(*best)):
        yield found


def _whole(item: str, k: int, text: str, start: int, end: int) -> Iterator[tuple[int, int, int]]:
    """As ``_regions``, for short items: only where no letter or digit continues the item's own."""
    m = len(item)

    def inside(at: int) -> bool:
        return 0 < at < len(text) and text[at - 1].isalnum() and text[at].isalnum()

    found = []
    for a in range(start, end):
        if not inside(a):
            for b in range(max(a + 1, a + m - k), min(end, a + m + k) + 1):
                if not inside(b) and (d := _edits(item, text[a:b])) <= k:
                    found.append((d, a, b))
    taken: list[tuple[int, int, int]] = []
    for d, a, b in sorted(found, key=lambda r: (r[0], r[1])):
        if all(b <= x or y <= a for _, x, y in taken):
            taken.append((d, a, b))
    yield from sorted(taken, key=lambda r: r[1])


def _edits(a: str, b: str) -> int:
    """Edit distance of two short texts."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(row[j] + 1, now[-1] + 1, row[j - 1] + (x != y)))
        row = now
    return row[-1]


def places(text: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, c in enumerate(text):
        out[c] = out.get(c, 0) | 1 << i
    return out


class Finder:
    """Finds a block of items in texts."""

    def __init__(self, items: list[tuple[int, str]], error_rate: float, short: bool = False):
        self.items, grouped = [], {}
        for item_id, text in items:
            text = level(text or "")
            if len(text) < MIN_CHARS:
                text = text.strip()
                if not short or not text:
                    continue
            n, m = len(self.items), len(text)
            k = int(m * error_rate)
            self.items.append((item_id, text, k, places(text), places(text[::-1])))
            cuts = [m * i // (k + 1) for i in range(k + 2)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                grouped.setdefault(text[a:b], []).append((n, a))
        self.hits = ahocorasick.Automaton()
        for piece, where in grouped.items():
            self.hits.add_word(piece, (len(piece), where))
        if grouped:
            self.hits.make_automaton()

    def find(self, text: str | None) -> list[tuple[int, int, int, int]]:
        """(item id, distance, start, end) of the closest occurrence of each item within its budget."""
        return [(self.items[n][0], *min(regions, key=lambda r: r[0])) for n, regions in self._found(text)]

    def find_all(self, text: str | None) -> list[tuple[int, int, int, int]]:
        """(item id, distance, start, end) of every separate occurrence of each item within its budget."""
        return [(self.items[n][0], *r) for n, regions in self._found(text) for r in regions]

    def _found(self, text: str | None) -> Iterator[tuple[int, list[tuple[int, int, int]]]]:
        """Numbers of the items that occur, and where, in order."""
        if not text or not self.items:
            return
        low = level(text)
        starts: dict[int, set[int]] = {}
        for last, (length, where) in self.hits.iter(low):
            for n, offset in where:
                starts.setdefault(n, set()).add(last + 1 - length - offset)
        for n, at in sorted(starts.items()):
            _, item, k, forward, backward = self.items[n]
            m, spans = len(item), self._spans(sorted(at), len(item), k, len(low))
            if m < MIN_CHARS:
                regions = [r for a, b in spans for r in _whole(item, k, low, a, b)]
            else:
                regions = [r for a, b in spans for r in _regions(forward, backward, m, k, low, a, b)]
            if regions:
                yield n, regions

    @staticmethod
    def _spans(starts: list[int], m: int, k: int, n: int) -> Iterator[tuple[int, int]]:
        """Where an item may lie, given where its hits put its start; overlapping places are joined."""
        a = b = None
        for s in starts:
            x, y = max(0, s - k), min(n, s + m + k)
            if a is not None and x <= b:
                b = max(b, y)
                continue
            if a is not None:
                yield a, b
            a, b = x, y
        yield a, b


def blocks(items: DataFrame, item_id: str, text: str, most: int = BLOCK_CHARS) -> Iterator[list[tuple[int, str]]]:
    """The items, in lists of at most about ``most`` characters."""
    block, size = [], 0
    for row in items.select(item_id, text).toLocalIterator():
        block.append((row[0], row[1] or ""))
        size += len(row[1] or "")
        if size >= most:
            yield block
            block, size = [], 0
    if block:
        yield block


def find_passages(
    df: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
    error_rate: float = ERROR_RATE, block_chars: int = BLOCK_CHARS, short: bool = False, every: bool = False,
) -> DataFrame:
    """(doc_id, item_id, distance, start, end): the closest occurrence of every item in every document that has it, or with ``every`` all of them."""
    spark, parts = df.sparkSession, []
    schema = "doc_id long, item_id long, distance long, start long, end long"
    rows = df.select(F.col(doc_id).cast("long").alias("d"), F.col(text).alias("t"))
    for block in blocks(items, item_id, item_text, block_chars):
        shared = spark.sparkContext.broadcast(block)

        def find(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            finder = Finder(shared.value, error_rate, short)
            look = finder.find_all if every else finder.find
            for b in batches:
                ids = b["d"].astype("Int64")
                found = [(d, *x) for d, t in zip(ids, b["t"], strict=True) for x in look(t)]
                out = pd.DataFrame(found, columns=["doc_id", "item_id", "distance", "start", "end"])
                yield out.astype({"doc_id": "Int64", "item_id": "Int64", "distance": "int64", "start": "int64", "end": "int64"})

        parts.append(rows.mapInPandas(find, schema))
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], schema)


def without_passages(
    df: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", error_rate: float = ERROR_RATE,
    block_chars: int = BLOCK_CHARS, short: bool = False,
) -> DataFrame:
    """The rows of ``df`` in which no item occurs, with all their columns; no shuffle."""
    for block in blocks(items, item_id, item_text, block_chars):
        df = keep_rows(df, _clean(df.sparkSession.sparkContext.broadcast(block), text, error_rate, short))
    return df


def _clean(shared, text: str, error_rate: float, short: bool):
    kept: list[Finder] = []

    def clean(p: pa.RecordBatch) -> list[bool]:
        if not kept:
            kept.append(Finder(shared.value, error_rate, short))
        return [not kept[0].find(t) for t in p.column(text).to_pylist()]

    return clean
