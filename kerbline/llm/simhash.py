"""SimHash near-duplicates with bit-sliced comparison.

Fingerprint: XXH64 (seed 42) of every run of four words (a shorter text is one run); a bit is set if more
than half of the hashes have it. A text without words has fingerprint zero.

Texts are near when their fingerprints differ in at most ``RADIUS`` bits. Cutting the 64 bits into
RADIUS + e blocks, two such fingerprints agree in e blocks at least, so fingerprints are grouped once for
every choice of e blocks; e is picked from the number of distinct fingerprints so that a random
group stays small. The groups of a partition lie one after another in lanes of 64-bit words: plane b of a
word holds bit b of 64 fingerprints. A fingerprint is compared with all lanes of a word at once: its bit
is XORed with each plane, the difference is added to three carry-save counter planes, and lanes whose count
passes the radius are marked dead; a word with no lane left alive is abandoned.

A group far larger than ``GROUP`` (very many different texts that share blocks) is cut into parts, and
every pair of parts becomes a task group of its own, so no task holds such a group and no pair
is left out. From each task only edges of a spanning forest come out, never all pairs. Equal fingerprints are one
vertex from the start, however many texts have them.

Null counts as the empty text. Rows are told apart by id and text; component ids are the smallest ids.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from kerbline.llm.components import components
from kerbline.llm.texts import row_key, with_columns
from kerbline.session import materialise

WORDS = 4
SEED = 42
RADIUS = 4
GROUP = 32_768
CHUNK = 262_144  # fingerprints compared together in a task, about
ALL = np.uint64(2**64 - 1)


def fingerprint(text: str | None) -> int:
    """The 64-bit fingerprint of a text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z change, only ASCII blanks split
    n = len(words)
    if not n:
        return 0
    if n < WORDS:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[: n - WORDS + 1].tolist(), ends[WORDS - 1 :].tolist(), strict=True)], np.uint64)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 65_536):
        ones += np.unpackbits(hashes[i : i + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def with_fingerprint(df: DataFrame, text: str, into: str = "fp") -> DataFrame:
    """``df`` with the fingerprint of ``text`` as a signed number; no shuffle."""

    def fill(p: pa.RecordBatch) -> dict[str, list]:
        return {into: [signed(fingerprint(t)) for t in p.column(text).to_pylist()]}

    return with_columns(df, {into: (pa.int64(), LongType())}, fill)


def choice(n: int, radius: int) -> tuple[int, int]:
    """Blocks and how many of them make a key, so that a random group of ``n`` fingerprints has about a word of lanes."""
    for more in range(1, 5):
        blocks = radius + more
        if n <= 64 * 2 ** (64 * more // blocks) or more == 4:
            return blocks, more
    raise AssertionError


def masks(blocks: int, chosen: int) -> list[int]:
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    single = [(1 << b) - (1 << a) for a, b in zip(cuts, cuts[1:], strict=False)]
    return [sum(c) for c in combinations(single, chosen)]


def signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


class Forest:
    """Which rows are already linked: labels only fall, towards the smallest row of a tree."""

    def __init__(self, n: int):
        self.label = np.arange(n)
        self.edges: list[tuple[np.ndarray, np.ndarray]] = []

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        label = self.label
        while len(i):
            a, b = label[i], label[j]
            open_ = a != b
            i, j, a, b = i[open_], j[open_], a[open_], b[open_]
            if not len(i):
                return
            high, low = np.maximum(a, b), np.minimum(a, b)
            order = np.lexsort((low, high))
            first = order[np.r_[True, high[order][1:] != high[order][:-1]]]  # each tree hooks onto one other
            self.edges.append((i[first], j[first]))
            label[high[first]] = low[first]
            while True:
                up = label[label]
                if (up == label).all():
                    break
                label[:] = up


def link(prints: np.ndarray, group: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Rows to link so that all rows of a group within the radius of each other are connected.

    ``group`` numbers the groups in order; rows of a group stand together.
    """
    n = len(prints)
    if n < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    words = -(-n // 64)
    padded = np.zeros(words * 64, np.uint64)
    padded[:n] = prints
    bits = np.unpackbits(padded.view(np.uint8).reshape(words, 64, 8), axis=2, bitorder="little")  # word, lane, bit
    planes = np.ascontiguousarray(np.packbits(bits.transpose(2, 0, 1), axis=2, bitorder="little")).view(np.uint64).reshape(64, words)
    own_bits = np.ascontiguousarray(bits.reshape(-1, 64)[:n].T)  # bit, row
    del bits
    row = np.arange(n)
    last = np.searchsorted(group, group, side="right") - 1  # last row of the row's group
    forest = Forest(n)
    reach = int((last // 64 - row // 64).max())
    for step in range(reach + 1):
        active = row[last // 64 >= row // 64 + step]
        for at in range(0, len(active), 65_536):
            i = active[at : at + 65_536]
            word = i // 64 + step
            # lanes that count: later rows of the same group
            lo, hi = np.maximum(i + 1 - word * 64, 0), np.minimum(last[i] + 1 - word * 64, 64)
            alive = _lanes(hi) & ~_lanes(lo)
            keep = alive != 0
            i, word, alive = i[keep], word[keep], alive[keep]
            one = two = four = None
            for bit in range(64):
                if bit % 8 == 0:
                    keep = alive != 0
                    if one is None or not keep.all():
                        i, word, alive = i[keep], word[keep], alive[keep]
                        one, two, four = (np.zeros(len(i), np.uint64) if x is None else x[keep] for x in (one, two, four))
                    if not len(i):
                        break
                d = planes[bit][word] ^ (own_bits[bit][i].astype(np.uint64) * ALL)
                carry = one & d
                one ^= d
                d = two & carry
                two ^= carry
                four, over = four ^ d, four & d
                if bit >= radius:
                    alive &= ~(over | _above(one, two, four, radius))
            if len(i):
                hit = np.unpackbits(alive.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                which, lane = np.nonzero(hit)
                forest.join(i[which], word[which] * 64 + lane)
    if not forest.edges:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([a for a, _ in forest.edges]), np.concatenate([b for _, b in forest.edges])


def _lanes(n: np.ndarray) -> np.ndarray:
    """Words with the lowest ``n`` (0 to 64) lanes set."""
    n = np.clip(n, 0, 64).astype(np.uint64)
    return np.where(n == 64, ALL, (np.uint64(1) << (n % np.uint64(64))) - np.uint64(1))


def _above(one, two, four, radius: int) -> np.ndarray:
    """Lanes whose three-bit count is larger than ``radius`` (below 7)."""
    out = np.zeros_like(one)
    for count in range(radius + 1, 8):
        out |= (one if count & 1 else ~one) & (two if count & 2 else ~two) & (four if count & 4 else ~four)
    return out


def compare(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Edges (a, b) among rows (g, fp) that come sorted by g; groups are taken whole, many at a time."""

    def edges(g: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        a, b = link(fp.view(np.uint64), np.unique(g, return_inverse=True)[1], radius)
        return pa.record_batch({"a": pa.array(fp[a]), "b": pa.array(fp[b])})

    g, fp = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for batch in batches:
        g = np.concatenate((g, batch.column("g").to_numpy(zero_copy_only=False)))
        fp = np.concatenate((fp, batch.column("fp").to_numpy(zero_copy_only=False)))
        if len(g) >= CHUNK:
            cut = int(np.searchsorted(g, g[-1]))  # the last group may go on
            if cut:
                yield edges(g[:cut], fp[:cut])
                g, fp = g[cut:], fp[cut:]
    if len(g):
        yield edges(g, fp)


def near_edges(prints: DataFrame, radius: int = RADIUS, group: int = GROUP) -> DataFrame:
    """(a, b): links that connect all distinct fingerprints (column fp) within ``radius`` of each other."""
    if not 0 <= radius <= 6:
        raise ValueError("the counters hold distances up to 7")
    blocks, chosen = choice(prints.count(), radius)
    keys = F.array(*[F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(signed(m)))) for i, m in enumerate(masks(blocks, chosen))])
    keyed = prints.select("fp", F.explode(keys).alias("g"))
    large = keyed.groupBy("g").agg(F.count("*").alias("n")).filter(F.col("n") > group)
    large = materialise(large.select("g", F.ceil(F.col("n") / group).cast("int").alias("parts")), "large")
    if not large.isEmpty():
        part = F.pmod(F.xxhash64("fp", F.lit(3)), F.col("parts")).cast("int")
        cut = keyed.join(large, "g", "left").withColumn("p", part).withColumn("q", F.explode(F.when(F.col("parts").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("parts") - 1))))
        pair = F.xxhash64("g", F.least("p", "q"), F.greatest("p", "q"))
        keyed = cut.select("fp", F.when(F.col("parts").isNull(), F.col("g")).otherwise(pair).alias("g"))
    parts = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = keyed.select("g", "fp").repartition(parts, "g").sortWithinPartitions("g")
    return dealt.mapInArrow(lambda it: compare(it, radius), "a long, b long").distinct()


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS, more: list[Column] | None = None) -> DataFrame:
    """(id, fp, root, component, size) per row of ``df``, and columns ``more`` of it.

    ``root`` names the group by a fingerprint, ``component`` by the smallest id reachable (null if all are null).
    """
    rows = df.select(F.col(doc_id).alias("id"), *(more or []), F.col(text).alias("_text"))
    rows = materialise(with_fingerprint(rows, "_text").drop("_text"), "prints")
    vertices = materialise(rows.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("n")), "vertices")
    roots = components(near_edges(vertices.select("fp"), radius)).withColumnRenamed("v", "fp")
    placed = vertices.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = placed.groupBy("root").agg(F.min("least").alias("component"), F.sum("n").alias("size"))
    classes = placed.select("fp", "root").join(named, "root").select("fp", "root", "component", "size")
    return rows.join(classes, "fp")


def drop_near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """One row of each group, that with the smallest id, with all columns of ``df``."""
    found = near_duplicates(df, doc_id, text, radius, [row_key(F.col(doc_id), F.col(text)).alias("key")])
    first = found.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("no"), "id", "key")).alias("k"))
    first = first.select(F.col("k.id").alias("_k_id"), F.col("k.key").alias("_k_key"))
    own = df.withColumn("_key", row_key(F.col(doc_id), F.col(text)))
    kept = own.join(first, own[doc_id].eqNullSafe(F.col("_k_id")) & (F.col("_key") == F.col("_k_key")), "left_semi")
    nth = F.row_number().over(Window.partitionBy(doc_id, "_key").orderBy(F.lit(1)))  # rows equal in id and text
    return kept.withColumn("_n", nth).filter("_n = 1").select(*df.columns)
