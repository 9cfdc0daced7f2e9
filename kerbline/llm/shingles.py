"""Near copies by the shingles they share, without misses.

The shingles of a text are its runs of ``WORDS`` words (a shorter text is one run, a text without words has the
one shingle 0), as a set of 64-bit hashes. Texts are near copies when their sets have a Jaccard similarity of
``LEAST`` or more. Candidates come from SimHash first: texts whose fingerprints differ in few bits are compared, and
those that are similar come together. At 0.8 texts differ in about 10 of the 64 bits and often in more, too many for
keys made of blocks of bits, so the pairs left are found by prefixes: with all shingles in one order, two
sets that similar share one of the first n - ceil(LEAST * n) + 1 of each. Any order gives all pairs; the one
used puts shingles that are frequent in a sample last, so that few texts meet without need.

Texts with equal sets are one vertex, named by a hash of the set. Shingles of one vertex only are dropped before
any pair is made. Shingles that crowd many prefixes without being known as frequent are counted and put last as
well. Then every vertex is paired with one centre, every shingle pairs its vertices with one of them, and only vertices that are still in different components are paired one by one. So a large group of near
copies has come together before any pairs are made within it. A vertex has a bitmap with about a bit per shingle, each
flipping one; two bitmaps differ in no more bits than the sets in shingles, so most pairs that are not similar are
dropped by them without a look at the texts: by their 256-bit folds while shingles are joined, by the whole bitmaps
afterwards. Pairs that are left are confirmed on the texts themselves.

Null counts as the empty text. Rows are told apart by id and text.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType

from kerbline.llm import simhash
from kerbline.llm.components import components
from kerbline.llm.exchange import WordHash, windows
from kerbline.llm.texts import SLICE_BYTES, hash_below, hold, pieces, released, row_key, with_columns
from kerbline.operators.contract import contracted
from kerbline.session import drop_table, materialise

OWNER = __name__
PAIRS = f"{__name__}.pairs"  # tasks that hash no words, so that they run without the words kept by those before them
WORDS = 5
LEAST = 0.8
SAMPLE_TEXTS = 16_000  # texts that tell which shingles are frequent; decides on cost only
FREQUENT = 500_000  # shingles that the order knows as frequent, at most
CROWDED = 48  # rows in whose prefix a shingle stands from which it counts as frequent
CENTRES = 1  # rounds in which a vertex is compared with one other
FOLD = 4  # 64-bit words of a bitmap's fold
STARS = 1  # rounds in which a shingle's vertices are compared with one of them

SHARED = pa.schema([("g", pa.int64()), ("v", pa.int64()), ("n", pa.int32())])
LINK = pa.schema([("a", pa.int64()), ("b", pa.int64())])

_WORDS = WordHash()


def _forget() -> None:
    _WORDS.clear()


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """The distinct shingles of a text, sorted."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()  # as in SimHash
    if not parts:
        return np.zeros(1, np.uint64)
    hold(OWNER, _forget)
    return np.unique(windows(_WORDS.of(parts), min(words, len(parts))))


def similarity(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """Sizes of the intersection and the union of two sets."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both, len(a) + len(b) - both


def prefix(own: np.ndarray, frequent: tuple[np.ndarray, np.ndarray], least: Fraction) -> np.ndarray:
    """The first shingles of a set, of which similar sets share one: rare ones first, then by hash."""
    n = len(own)
    size = n - -(-least.numerator * n // least.denominator) + 1
    known, counts = frequent
    rank = np.zeros(n, np.int64)
    if len(known):
        at = np.minimum(np.searchsorted(known, own), len(known) - 1)
        rank = np.where(known[at] == own, counts[at], 0)
    return own[np.argsort(rank, kind="stable")[:size]]


def parities(own: np.ndarray) -> bytes:
    """A bitmap of 64 bits or more, a power of two, in which every shingle flips a bit."""
    size = max(64, 1 << (len(own) - 1).bit_length())
    return np.packbits(np.bincount((own & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1).tobytes()


def fold(own: np.ndarray) -> list[int]:
    """The bitmap of a set on ``FOLD`` words, for the comparison inside a join."""
    odd = np.bincount((own & np.uint64(64 * FOLD - 1)).astype(np.int64), minlength=64 * FOLD) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).tolist()


def fits(least: Fraction) -> Column:
    """Rows (n, f) and (m, e) may be similar by the sizes and the folds of their sets."""
    p, q = least.numerator, least.denominator
    sizes = F.least("n", "m").cast("long") * q >= F.greatest("n", "m").cast("long") * p
    differ = sum((F.bit_count(F.col("f")[i].bitwiseXOR(F.col("e")[i])) for i in range(FOLD)), F.lit(0))
    return sizes & (differ.cast("long") * (q + p) <= (F.col("n").cast("long") + F.col("m")) * (q - p))


def apart(x: bytes, y: bytes) -> int:
    """In how many shingles two sets differ at least; the longer bitmap is folded."""
    if len(x) > len(y):
        x, y = y, x
    short, long = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    return int(np.bitwise_count(short ^ np.bitwise_xor.reduce(long.reshape(-1, len(short)), axis=0)).sum())


def frequent_shingles(df: DataFrame, text: str, words: int = WORDS, sample: int = SAMPLE_TEXTS, most: int = FREQUENT) -> tuple[np.ndarray, np.ndarray]:
    """Shingles seen in several texts of a sample drawn by hash, sorted, and in how many."""
    rows = df.select(F.coalesce(F.col(text), F.lit("")).alias("t"))
    n = rows.count()
    few = rows.filter(hash_below(F.xxhash64("t"), F.lit(min(1.0, sample / max(n, 1)))))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in b.column(0):
                yield pa.record_batch({"h": pa.array(shingles(t.as_py(), words).view(np.int64))})

    counted = few.mapInArrow(released(OWNER, sets), "h long").groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").orderBy(F.desc("n"), "h").limit(most).toArrow()
    known, times = (counted.column(c).to_numpy().astype(np.int64) for c in ("h", "n"))
    known = known.view(np.uint64)
    order = np.argsort(known)
    return known[order], times[order]


def crowded_shingles(prints: DataFrame, least: int = CROWDED, most: int = FREQUENT) -> tuple[np.ndarray, np.ndarray]:
    """Shingles in the prefixes of many rows, sorted, and of how many; the ``most`` most crowded ones."""
    seen = prints.select(F.explode("keys").alias("h")).groupBy("h").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    found = seen.orderBy(F.desc("n"), "h").limit(most).toArrow()
    known, times = (found.column(c).to_numpy().astype(np.int64) for c in ("h", "n"))
    known = known.view(np.uint64)
    order = np.argsort(known)
    return known[order], times[order]


def with_prefix(df: DataFrame, text: str, frequent: tuple[np.ndarray, np.ndarray], words: int, least: Fraction) -> DataFrame:
    """``df`` with the name ``v`` of a text's set, its size ``n``, its bitmap ``bits``, the fold ``f`` of it and its prefix ``keys``; no shuffle."""
    shared = df.sparkSession.sparkContext.broadcast(frequent)

    def fill(p: pa.RecordBatch) -> dict[str, list]:
        sets = [shingles(t, words) for t in p.column(text).to_pylist()]
        return {
            "v": [xxhash.xxh64_intdigest(s.tobytes()) - 2**63 for s in sets], "n": [len(s) for s in sets], "bits": [parities(s) for s in sets], "f": [fold(s) for s in sets],
            "keys": [prefix(s, shared.value, least).view(np.int64) for s in sets]}

    kinds = {"v": (pa.int64(), LongType()), "n": (pa.int32(), IntegerType()), "bits": (pa.binary(), BinaryType()), "f": (pa.list_(pa.int64()), ArrayType(LongType())), "keys": (pa.list_(pa.int64()), ArrayType(LongType()))}
    return with_columns(df, kinds, fill)


def several(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (g, v, n) sorted by g and v the different ones whose g has several v; only the last row is kept back."""
    last, given = None, False
    for b in batches:
        g, v, n = (b.column(c).to_numpy(zero_copy_only=False) for c in SHARED.names)
        if not len(g):
            continue
        if last is not None:
            g, v, n = (np.concatenate(x) for x in zip(last, (g, v, n), strict=True))
        new = np.r_[True, (g[1:] != g[:-1]) | (v[1:] != v[:-1])]
        g, v, n = g[new], v[new], n[new]
        same = g[1:] == g[:-1]
        hit = np.r_[False, same] | np.r_[same, False]
        if last is not None and given:
            hit[0] = False
        given = bool(hit[-1]) if len(g) > 1 else given
        last = g[-1:], v[-1:], n[-1:]
        yield pa.record_batch([pa.array(x[hit]) for x in (g, v, n)], schema=SHARED)


shared_task = released(PAIRS, several)


def shared_keys(prints: DataFrame) -> DataFrame:
    """(g, v, n) for the shingles in the prefixes of several vertices."""
    parts = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = prints.select(F.explode("keys").alias("g"), "v", "n").repartition(parts, "g").sortWithinPartitions("g", "v")
    return dealt.mapInArrow(shared_task, "g long, v long, n int")


def sets_of(df: DataFrame, doc_id: str, text: str, prints: DataFrame, vertices: DataFrame, words: int, repeated: bool) -> DataFrame:
    """(v, s): the sets of some vertices, packed, from one row of ``df`` for each. ``repeated``: rows may be equal in id and text."""
    row = prints.join(vertices, "v", "left_semi").groupBy("v").agg(F.min(F.struct("id", "key")).alias("r")).select("v", F.col("r.id").alias("_s_id"), F.col("r.key").alias("_s_key"))
    own = df.select(F.col(doc_id).alias("_id"), row_key(F.col(doc_id), F.col(text)).alias("_key"), F.col(text).alias("t"))
    found = own.join(row, F.col("_id").eqNullSafe(F.col("_s_id")) & (F.col("_key") == F.col("_s_key"))).select("v", "t")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p in pieces(b, SLICE_BYTES):
                yield pa.record_batch({"v": p.column(0), "s": pa.array([shingles(t, words).tobytes() for t in p.column(1).to_pylist()], pa.binary())})

    sets = found.mapInArrow(released(OWNER, pack), "v long, s binary")
    return sets.dropDuplicates(["v"]) if repeated else sets


def plausible(pairs: DataFrame, bits: DataFrame, least: Fraction) -> DataFrame:
    """The pairs (a, b; sizes n, m) that their bitmaps don't rule out: similar sets differ in few shingles."""
    side = lambda x: bits.select(F.col("v").alias(x), F.col("bits").alias(f"s{x}"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, q = least.numerator, least.denominator
        for b in batches:
            total = np.add(b.column("n").to_numpy(), b.column("m").to_numpy(), dtype=np.int64)
            good = [apart(x.as_py(), y.as_py()) * (q + p) <= t * (q - p) for x, y, t in zip(b.column("sa"), b.column("sb"), total.tolist(), strict=True)]
            yield b.select(["a", "b"]).filter(pa.array(good, pa.bool_())).cast(LINK)

    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "n", "m", "sa", "sb").mapInArrow(released(PAIRS, check), "a long, b long")


def confirmed(pairs: DataFrame, sets: DataFrame, least: Fraction) -> DataFrame:
    """The pairs (a, b) whose sets are similar."""
    side = lambda x: sets.select(F.col("v").alias(x), F.col("s").alias(f"s{x}"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good = []
            for x, y in zip(b.column("sa"), b.column("sb"), strict=True):
                both, either = similarity(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64))
                good.append(both * least.denominator >= either * least.numerator)
            yield b.select(["a", "b"]).filter(pa.array(good, pa.bool_())).cast(LINK)

    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "sa", "sb").mapInArrow(released(PAIRS, check), "a long, b long")


def simhash_pairs(marks: DataFrame, sizes: DataFrame, radius: int = simhash.RADIUS) -> DataFrame:
    """Candidates (a, b; sizes n, m) by SimHash, from ``marks`` (v, fp): vertices of one fingerprint meet the smallest of
    them, and the smallest ones of linked fingerprints meet. So their number is that of vertices and links."""
    first = materialise(marks.groupBy("fp").agg(F.min("v").alias("w")), "marks")
    edges = simhash.near_edges(first.select("fp"), radius)
    side = lambda x: first.select(F.col("fp").alias(x), F.col("w").alias(f"v{x}"))
    met = marks.join(first, "fp").select("v", "w").union(edges.join(side("a"), "a").join(side("b"), "b").select("va", "vb")).filter("v <> w")
    pairs = met.select(F.least("v", "w").alias("a"), F.greatest("v", "w").alias("b")).distinct()
    size = lambda x, n: sizes.select(F.col("v").alias(x), F.col("n").alias(n))
    return pairs.join(size("a", "n"), "a").join(size("b", "m"), "b").select("a", "b", F.least("n", "m").alias("n"), F.greatest("n", "m").alias("m"))


def links(df: DataFrame, doc_id: str, text: str, prints: DataFrame, marks: DataFrame, words: int, least: Fraction) -> DataFrame:
    """(v, root) for the vertices that are similar to others, over any number of steps."""
    live = materialise(shared_keys(prints), "shared")
    shared = prints.join(live.select("v"), "v", "left_semi").groupBy("v")
    bits = materialise(shared.agg(F.first("n").alias("n"), F.first("bits").alias("bits"), F.first("f").alias("f")), "bits")
    live = live.join(bits.select("v", "f"), "v").select("g", "v", "n", "f")  # vertices that share no prefix shingle are similar to none
    repeated = not prints.groupBy("id", "key").agg(F.count("*").alias("c")).filter("c > 1").isEmpty()

    def settle(pairs: DataFrame, roots: DataFrame) -> DataFrame:
        """``roots`` after the similar ones of the pairs have come together. Every exchange takes a thread of the driver
        for a minute, so what would change nothing is not run."""
        pairs = materialise(plausible(pairs, bits, least), "pairs")
        if pairs.isEmpty():
            return roots
        sets = materialise(sets_of(df, doc_id, text, prints, pairs.select(F.explode(F.array("a", "b")).alias("v")), words, repeated), "sets")
        similar = materialise(confirmed(pairs, sets, least), "similar")
        if similar.isEmpty():
            return roots
        return components(contracted(roots.select(F.col("v").alias("a"), F.col("root").alias("b")).filter("a <> b").union(similar)))

    none = df.sparkSession.createDataFrame([], "v long, root long")
    roots = settle(simhash_pairs(marks.join(bits.select("v"), "v", "left_semi"), bits), none)
    for turn in range(CENTRES + STARS + 1):
        placed = live.select("g", "v", "n", "f").join(roots, "v", "left").withColumn("root", F.coalesce("root", "v"))
        open_ = placed.groupBy("g").agg(F.min("root").alias("x"), F.max("root").alias("y")).filter("x <> y").select("g")
        live = materialise(placed.join(open_, "g", "left_semi").select("g", "v", "n", "f", "root"), "live")
        if live.isEmpty():
            break
        if turn < CENTRES + STARS:
            one = live.groupBy("g").agg(F.min(F.struct(F.xxhash64("v", F.lit(turn)).alias("h"), "v", "n", "f", "root")).alias("o"))
            one = one.select("g", F.col("o.v").alias("w"), F.col("o.n").alias("m"), F.col("o.f").alias("e"), F.col("o.root").alias("other"))
        else:
            one = live.select("g", F.col("v").alias("w"), F.col("n").alias("m"), F.col("f").alias("e"), F.col("root").alias("other"))
        met = live.join(one, "g").filter((F.col("root") != F.col("other")) & fits(least))
        if turn < CENTRES:  # of the centres of a vertex's shingles the one with the smallest hash
            met = met.groupBy("v", "n").agg(F.min(F.struct(F.xxhash64("w", F.lit(turn)).alias("h"), "w", "m")).alias("o")).select("v", "n", "o.w", "o.m")
        elif turn == CENTRES + STARS:
            met = met.filter("v < w")
        roots = settle(met.select(F.least("v", "w").alias("a"), F.greatest("v", "w").alias("b"), F.least("n", "m").alias("n"), F.greatest("n", "m").alias("m")).distinct(), roots)
    return roots


def near_copies(df: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, least: float = LEAST) -> DataFrame:
    """(id, key, v, root) per row of ``df``; rows with one root are near copies, directly or through others."""
    share = Fraction(str(least))
    frequent = frequent_shingles(df, text, words)
    rows = df.select(F.col(doc_id).alias("id"), row_key(F.col(doc_id), F.col(text)).alias("key"), F.col(text).alias("_text"))
    prints = materialise(with_prefix(simhash.with_fingerprint(rows, "_text"), "_text", frequent, words, share).drop("_text"), "prefixes")
    marks = materialise(prints.select("v", "fp").distinct(), "marks")
    crowded = crowded_shingles(prints)
    if len(crowded[0]):
        known = np.setdiff1d(frequent[0], crowded[0])
        times = frequent[1][np.searchsorted(frequent[0], known)]
        both, counts = np.concatenate([known, crowded[0]]), np.concatenate([times, crowded[1] + (int(times.max()) if len(times) else 0)])
        order = np.argsort(both)
        again = with_prefix(rows, "_text", (both[order], counts[order]), words, share).drop("_text")
        drop_table(df.sparkSession, prints)
        prints = materialise(again, "prefixes")
    roots = links(df, doc_id, text, prints, marks, words, share)
    return prints.select("id", "key", "v").join(roots, "v", "left").select("id", "key", "v", F.coalesce("root", "v").alias("root"))


def drop_near_copies(df: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, least: float = LEAST) -> DataFrame:
    """One row of each group, that with the smallest id, with all columns of ``df``; rows without near copies are not shuffled unless the others are many."""
    found = materialise(near_copies(df, doc_id, text, words, least), "copies")
    first = found.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("no"), "id", "key")).alias("k"), F.count("*").alias("c")).filter("c > 1")
    many = found.join(first, "root", "left_semi").select(F.col("id").alias("_k_id"), F.col("key").alias("_k_key")).distinct()
    first = first.select(F.col("k.id").alias("_k_id"), F.col("k.key").alias("_k_key"))
    own = df.withColumn("_key", row_key(F.col(doc_id), F.col(text)))
    same = lambda other: own[doc_id].eqNullSafe(other["_k_id"]) & (own["_key"] == other["_k_key"])
    alone = own.join(many, same(many), "left_anti").select(*df.columns)
    nth = F.row_number().over(Window.partitionBy(doc_id, "_key").orderBy(F.lit(1)))  # rows equal in id and text
    return alone.union(own.join(first, same(first), "left_semi").withColumn("_n", nth).filter("_n = 1").select(*df.columns))
