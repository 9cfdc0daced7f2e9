"""How far the word use of a language's sources lies apart.

First pass: documents per (language, term), counted exactly; terms in at least ``min_docs`` documents of a language
are kept. The kept terms are dealt into shards by hash, and a task builds a minimal perfect hash per shard, with the
terms themselves stored by slot. Second pass: blocks of shards of a fixed size are broadcast, every task counts its terms in
dense slots, one array per (language, source) group, after comparing the stored term; a pass over the documents serves
``BLOCK_SHARDS`` shards, about a million terms.

Shares are p = 1 + floor(scale * (count + prior) / (N + prior * V)), V kept terms of the language, N the group's
occurrences of them: whole numbers, computed as decimals. Two sources are compared over all kept terms in tiles
of (sources, sources, terms), so no task holds a language. Terms that neither source uses count as well.

Terms are runs of letters A-Z (lower-cased) and of all characters beyond ASCII. A null text, language or source is the empty
string. Every occurring group is compared, with terms or without; a language with one source has no pairs. Repeated
rows count each time; texts of any length are read whole; an empty table gives no rows. Columns of other names are not read.
"""

from __future__ import annotations

import pickle
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbline.llm.perfect import PerfectHash
from kerbline.llm.texts import SLICE_BYTES, pieces, release_others
from kerbline.session import materialise

MIN_DOCS, PRIOR, SCALE, TOP = 30, 5, 1_000_000_000, 50
SHARD_TERMS = 65_536
BLOCK_SHARDS = 16  # shards broadcast together: about a million terms
STORE = 300_000  # different terms that a task counts before it passes them on
DENSE_BYTES = 48_000_000  # of slots that a task holds before it passes them on
TILE_SOURCES, TILE_TERMS = 128, 4096

#: Bytes of terms as they are, with A-Z lower-cased; all other ASCII becomes a space.
_LETTERS = bytes(b if b >= 128 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def terms(text: bytes) -> list[bytes]:
    return text.translate(_LETTERS).split()


def _rows(df: DataFrame, lang: str, source: str, text: str) -> DataFrame:
    plain = lambda c: F.coalesce(F.col(c), F.lit(""))
    return df.select(plain(lang).alias("lang"), plain(source).alias("source"), plain(text).cast("binary").alias("text"))


def _slices(batches) -> Iterator[pa.RecordBatch]:
    release_others(__name__)
    for b in batches:
        yield from pieces(b, SLICE_BYTES)


def frequent_terms(docs: DataFrame, min_docs: int) -> DataFrame:
    """(lang, term) of the terms in at least ``min_docs`` documents of the language."""

    def run(batches):
        found: dict[str, Counter] = defaultdict(Counter)

        def out():
            for lang, counter in found.items():
                yield pa.record_batch([pa.array([lang] * len(counter), pa.string()), pa.array(list(counter), pa.binary()), pa.array(list(counter.values()), pa.int64())], names=["lang", "term", "n"])
            found.clear()

        for p in _slices(batches):
            for lang, text in zip(p.column("lang").to_pylist(), p.column("text").to_pylist(), strict=True):
                found[lang].update(set(terms(text)))
                if len(found[lang]) > STORE or len(found) > STORE:
                    yield from out()
            if sum(map(len, found.values())) > STORE:
                yield from out()
        yield from out()

    seen = docs.select("lang", "text").mapInArrow(run, "lang string, term binary, n long")
    return seen.groupBy("lang", "term").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_docs).select("lang", F.col("term").cast("string").alias("term"))


def _key(lang: str, term: bytes) -> bytes:
    return lang.encode() + b"\0" + term  # no term holds a zero byte


class Shard:
    """A perfect hash over some (language, term) keys, which are stored by slot."""

    def __init__(self, keys: list[bytes]):
        self.seed = 0
        while True:
            hashed = self.hashed(keys)
            if len(np.unique(hashed)) == len(keys):
                break
            self.seed += 1  # two keys fell on one number
        self.hash = PerfectHash(hashed)
        order = self.hash.in_order(hashed).tolist()
        self.keys = pa.array([keys[i] for i in order], pa.binary())

    def hashed(self, keys: list[bytes]) -> np.ndarray:
        return np.fromiter((xxhash.xxh64_intdigest(k, self.seed) for k in keys), np.uint64, len(keys))

    def find(self, keys: list[bytes]) -> np.ndarray:
        """The slot of each key, -1 where the key is not in the shard."""
        at = self.hash.slots(self.hashed(keys))
        if not self.hash.n:
            return at
        stored = self.keys.take(pa.array(np.maximum(at, 0)))
        same = pc.equal(stored, pa.array(keys, pa.binary())).to_numpy(zero_copy_only=False)
        return np.where(same & (at >= 0), at, -1)


def _shard_of(key: Column, n: int) -> Column:
    return (F.shiftrightunsigned(F.xxhash64(key), 32) % n).cast("int")


def shards_of(kept: DataFrame, n: int) -> DataFrame:
    """(shard, shape): the perfect hash of each shard."""
    key = F.concat(F.col("lang").cast("binary"), F.lit(b"\0"), F.col("term").cast("binary"))
    keyed = kept.select(key.alias("key")).withColumn("shard", _shard_of(F.col("key"), n))

    def build(table: pa.Table) -> pa.Table:
        shape = pickle.dumps(Shard(table.column("key").to_pylist()), protocol=5)
        return pa.table({"shard": table.column("shard").slice(0, 1).combine_chunks(), "shape": pa.array([shape], pa.binary())})

    return keyed.groupBy("shard").applyInArrow(build, "shard int, shape binary")


def _count(shapes, n: int):
    """Task function: (lang, source, term, n) of the terms in the broadcast shards, counted in dense slots."""

    def run(batches):
        known = {shard: pickle.loads(shape) for shard, shape in shapes.value}
        words: dict[tuple[str, str], Counter] = defaultdict(Counter)
        slots: dict[tuple[str, str, int], np.ndarray] = {}

        def settle():
            for (lang, source), counter in words.items():
                keys = [_key(lang, t) for t in counter]
                times = np.fromiter(counter.values(), np.int64, len(counter))
                shard = np.fromiter((xxhash.xxh64_intdigest(k, 42) for k in keys), np.uint64, len(keys)) >> np.uint64(32)
                shard = (shard % np.uint64(n)).astype(np.int64)
                for s in np.unique(shard).tolist():
                    if s not in known:
                        continue
                    of = np.flatnonzero(shard == s)
                    at = known[s].find([keys[i] for i in of.tolist()])
                    if (at < 0).all():
                        continue
                    if (lang, source, s) not in slots:
                        slots[lang, source, s] = np.zeros(known[s].hash.n, np.int64)
                    slots[lang, source, s][at[at >= 0]] += times[of[at >= 0]]
            words.clear()

        def out():
            for (lang, source, s), counts in slots.items():
                used = np.flatnonzero(counts)
                found = [k[k.rindex(b"\0") + 1 :] for k in known[s].keys.take(pa.array(used)).to_pylist()]
                yield pa.record_batch(
                    [pa.array([lang] * len(used), pa.string()), pa.array([source] * len(used), pa.string()), pa.array(found, pa.binary()), pa.array(counts[used])],
                    names=["lang", "source", "term", "n"])
            slots.clear()

        for p in _slices(batches):
            for lang, source, text in zip(*(p.column(c).to_pylist() for c in ("lang", "source", "text")), strict=True):
                words[lang, source].update(terms(text))
                if len(words[lang, source]) > STORE or len(words) > STORE:
                    settle()
            if sum(map(len, words.values())) > STORE:
                settle()
            if sum(a.nbytes for a in slots.values()) > DENSE_BYTES:
                yield from out()
        settle()
        yield from out()

    return run


def recount(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """(lang, source, term, n) for the kept terms that occur in a group; materialised."""
    spark = docs.sparkSession
    n = -(-max(1, kept.count()) // SHARD_TERMS)
    shards = materialise(shards_of(kept, n), "shards")
    found = None
    for first in range(0, n, BLOCK_SHARDS):
        block = shards.filter(F.col("shard").between(first, first + BLOCK_SHARDS - 1)).collect()  # a fixed number of terms
        shapes = spark.sparkContext.broadcast([(r["shard"], bytes(r["shape"])) for r in block])
        part = docs.mapInArrow(_count(shapes, n), "lang string, source string, term binary, n long")
        part = materialise(part.groupBy("lang", "source", F.col("term").cast("string").alias("term")).agg(F.sum("n").alias("n")), "counts")
        found = part if found is None else found.unionByName(part)  # a term is in one shard
        shapes.destroy()
    return found


def _share(count: str) -> Column:
    """1 + floor(scale * (count + prior) / (total + prior * v)), exact at any count."""
    return F.expr(
        f"1 + cast({SCALE} as decimal(10, 0)) * cast({count} + {PRIOR} as decimal(19, 0)) div cast(total + {PRIOR} * v as decimal(19, 0))")


def _tile(table: pa.Table) -> pa.Table:
    """Sums of |p - p'| over the terms of a tile, less those of terms that nobody uses, by pair of sources."""
    lang, block, i, j = (table.column(c)[0].as_py() for c in ("lang", "block", "i", "j"))
    rows = table.column("term").is_null().to_numpy()
    head, body = table.filter(pa.array(rows)), table.filter(pa.array(~rows))
    names = head.column("source").to_pylist()
    zero, v, tile = (head.column(c).to_numpy() for c in ("p", "v", "tile"))
    term = body.column("term").combine_chunks().dictionary_encode()
    at = pc.index_in(body.column("source"), pa.array(names, pa.string())).to_numpy()
    width = len(term.dictionary)
    share = np.repeat(zero[:, None], width, axis=1)
    share[at, term.indices.to_numpy()] = body.column("p").to_numpy()
    left, right = np.flatnonzero(tile == i), np.flatnonzero(tile == j)
    a_, b_, sums = [], [], []
    for k, a in enumerate(left.tolist()):
        others = right[k + 1 :] if i == j else right
        apart = np.abs(zero[others] - zero[a])
        a_.append(np.full(len(others), a))
        b_.append(others)
        sums.append(np.abs(share[others] - share[a]).sum(1) + apart * (v[others] * (block == 0) - width))
    a, b = np.concatenate([*a_, np.zeros(0, np.int64)]), np.concatenate([*b_, np.zeros(0, np.int64)])
    names_ = pa.array(names, pa.string())
    return pa.table({
        "lang": pa.array([lang] * len(a), pa.string()), "a": names_.take(pa.array(a)), "b": names_.take(pa.array(b)),
        "value": pa.array(np.concatenate([*sums, np.zeros(0, np.int64)]).astype(np.int64))})


def distances(groups: DataFrame, shares: DataFrame) -> DataFrame:
    """(lang, source, item, value) for all ordered pairs of a language's sources.

    ``groups``: lang, source, v, zero (the share of an unused term), tiles, blocks; ``shares``: also term, p.
    """
    tile = F.pmod(F.xxhash64("source"), "tiles").cast("int").alias("tile")
    every = lambda n: F.explode(F.sequence(F.lit(0), (F.col(n) - 1).cast("int")))
    heads = groups.select("lang", "source", tile, "tiles", F.lit(None).cast("string").alias("term"), F.col("zero").alias("p"), "v", every("blocks").alias("block"))
    body = shares.select("lang", "source", tile, "tiles", "term", "p", "v", F.pmod(F.xxhash64("term"), "blocks").cast("int").alias("block"))
    dealt = heads.unionByName(body).withColumn("other", every("tiles"))
    dealt = dealt.select("lang", "source", "tile", "term", "p", "v", "block", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"))
    sums = dealt.groupBy("lang", "block", "i", "j").applyInArrow(_tile, "lang string, a string, b string, value long").groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    both = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    return sums.select("lang", "value", both.alias("x")).select("lang", "x.source", "x.item", "value")


def audit(df: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """One row per compared source (part ``pair``) and per overused term up to rank ``top`` (part ``term``).

    Columns: lang, source, part, item, value, rank. Ranks run from 1 per group and part, larger values first, equal
    ones by item.
    """
    docs = _rows(df, lang, source, text)
    kept = materialise(frequent_terms(docs, min_docs), "kept")
    counts = recount(docs, kept)
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    size = kept.groupBy("lang").agg(F.count("*").alias("v"))
    groups = docs.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(size, "lang", "left").fillna(0, ["total", "v"])
    several = groups.groupBy("lang").agg(F.count("*").alias("k"))
    groups = materialise(groups.join(several, "lang").select(
        "lang", "source", "total", "v", F.when(F.col("v") > 0, _share("0")).otherwise(0).alias("zero"),
        F.ceil(F.col("k") / TILE_SOURCES).alias("tiles"), F.greatest(F.lit(1), F.ceil(F.col("v") / TILE_TERMS)).alias("blocks")), "groups")
    shares = counts.join(groups, ["lang", "source"]).withColumn("p", _share("n"))
    whole = groups.groupBy("lang").agg(F.sum("total").alias("total"), F.first("v").alias("v"))
    common = counts.groupBy("lang", "term").agg(F.sum("n").alias("n")).join(whole, "lang").select("lang", "term", _share("n").alias("q"))
    over = shares.select("lang", "source", F.col("term").alias("item"), "p").join(common.withColumnRenamed("term", "item"), ["lang", "item"]).filter("p > q")
    over = over.select("lang", "source", "item", (F.col("p") - F.col("q")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda d, part: d.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
    return ranked(distances(groups, shares), "pair").unionByName(ranked(over, "term").filter(F.col("rank") <= top))


#: The same report in SQL (production parameters).
AUDIT_SQL = r"""
    with d as (
        select row_number() over () as i, coalesce(lang, '') as lang, coalesce(source, '') as source,
            regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as words
        from documents),
    w as (select i, lang, source, unnest(words) as term from d),
    kept as (select lang, term from w group by lang, term having count(distinct i) >= 30),
    counts as (select w.lang, w.source, w.term, count(*) as n from w join kept k on k.lang = w.lang and k.term = w.term group by all),
    g as (select distinct lang, source from d),
    v as (select g.lang, count(k.term) as v from (select distinct lang from g) g left join kept k on k.lang = g.lang group by g.lang),
    t as (
        select g.lang, g.source, v.v, coalesce(sum(c.n), 0) as total
        from g join v on v.lang = g.lang left join counts c on c.lang = g.lang and c.source = g.source group by all),
    p as (
        select t.lang, t.source, k.term, coalesce(c.n, 0) as n,
            1 + (1000000000::hugeint * (coalesce(c.n, 0) + 5)) // (t.total + 5 * t.v)::hugeint as p
        from t join kept k on k.lang = t.lang left join counts c on c.lang = t.lang and c.source = t.source and c.term = k.term),
    lt as (select lang, sum(total) as total, any_value(v) as v from t group by lang),
    q as (
        select k.lang, k.term, 1 + (1000000000::hugeint * (coalesce(sum(c.n), 0) + 5)) // (any_value(lt.total) + 5 * any_value(lt.v))::hugeint as q
        from kept k join lt on lt.lang = k.lang left join counts c on c.lang = k.lang and c.term = k.term group by k.lang, k.term),
    pairs as (
        select a.lang, a.source, b.source as item, coalesce(sum(abs(x.p - y.p)), 0) as value
        from g a join g b on a.lang = b.lang and a.source <> b.source
        left join p x on x.lang = a.lang and x.source = a.source
        left join p y on y.lang = b.lang and y.source = b.source and y.term = x.term
        group by all),
    over_ as (select p.lang, p.source, p.term as item, p.p - q.q as value from p join q on q.lang = p.lang and q.term = p.term where p.n > 0 and p.p > q.q),
    ranked as (
        select lang, source, 'pair' as part, item, value, row_number() over (partition by lang, source order by value desc, item) as rank from pairs
        union all
        select lang, source, 'term', item, value, row_number() over (partition by lang, source order by value desc, item) from over_)
    select lang, source, part, item, value::bigint as value, rank::int as rank from ranked where part = 'pair' or rank <= 50"""
