"""Personal data, and terms that give it away.

Base spans. E-mail addresses, IP addresses, card numbers and phone numbers are found by rule in every text.

Information-theoretic sanitisation. Every distinct value of a base span is a protected entity e. Over all
documents N, with df counting documents, the information of an entity is IC(e) = -log2(df(e) / N), and a
term t beside it discloses PMI(e; t) = log2(N * df(e, t) / (df(e) * (df(t) + ``PRIOR``))) of it: nearly all of IC(e)
where the term occurs only with the entity, nothing where the two are independent. In documents that hold the
entity, a term is generalised from ``GENERALISE`` * IC(e) on and removed from ``REMOVE`` * IC(e) on. Entities of a
single document count like all others: most personal data is unique. The added ``PRIOR`` keeps a term from passing
for telling only because the corpus is small; for df(e) = 1 the share of IC is log(N / (df(t) + PRIOR)) / log(N), which
grows with the corpus. Texts without an entity are left alone.

The counts cover all documents. df(t) is needed only for terms beside some entity; a bit
table of fixed size (broadcast) lets the counting pass skip nearly all other words, and what it lets
through by chance is dropped by an exact join.

A null text is an empty text; it has no spans. Rows equal in id and text count as documents each and
get the same spans.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from kerbline.llm.texts import row_key
from kerbline.session import materialise

MIN_JOINT = 1  # documents that a pair must be seen in; more would leave out what is unique
PRIOR = 5  # documents added to those that a term is seen in
GENERALISE = 0.8
REMOVE = 0.95
BITS = 22  # the bit table has 2**BITS bits
KINDS = ["email", "ip", "card", "phone", "general", "removed"]  # the last two come from the method
BASE = 4
ENTITY_TAG = {"email": "<EMAIL>", "ip": "<IP>", "card": "<CARD>", "phone": "<PHONE>", "general": "<TERM>", "removed": ""}

# The letters and shapes that the kinds are defined by.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DIGIT = re.compile(r"[0-9]")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
SPACED = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TERM = re.compile(r"[^\W\d_]{3,}")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches; each ``@`` is tried once with all local letters before it."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            free = domain.end()
            yield start, free
        at = text.find("@", max(at + 1, free))


def ips(text: str) -> Iterator[tuple[int, int]]:
    """Groups of four in each run of dotted numbers, from its left."""
    for run in DOTTED.finditer(text):
        parts, at = run.group().split("."), run.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                yield at, end
            at = end + 1


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def cards(text: str) -> Iterator[tuple[int, int]]:
    for m in SPACED.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            yield m.span()


def phones(text: str) -> Iterator[tuple[int, int]]:
    for m in PHONE.finditer(text):
        if 9 <= len(DIGIT.findall(m.group())) <= 15:
            yield m.span()


def base_spans(text: str | None) -> list[tuple[int, int, int]]:
    """(start, kind number, end), by start and kind."""
    if not text:
        return []
    out = [(a, 0, b) for a, b in emails(text)]
    if DIGIT.search(text):
        out += [(a, 1, b) for a, b in ips(text)] + [(a, 2, b) for a, b in cards(text)] + [(a, 3, b) for a, b in phones(text)]
    return sorted(out)


def entity(text: str, span: tuple[int, int, int]) -> int:
    """A name for the value of a span: letter case and the blanks in a number don't matter."""
    value = text[span[0] : span[2]].lower()
    if span[1] >= 2:
        value = re.sub(r"[^0-9]", "", value)
    return _hash(f"{span[1]}:{value}")


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - 2**63


def terms(text: str, spans: list[tuple[int, int, int]]) -> Iterator[tuple[str, int, int]]:
    """Words outside the base spans, with their places."""
    covered = iter(_merged(spans))
    a, b = next(covered, (len(text), len(text)))
    for m in TERM.finditer(text):
        start, end = m.span()
        while b <= start:
            a, b = next(covered, (len(text) + 1, len(text) + 1))
        if end <= a:
            yield m.group().lower(), start, end


def _merged(spans: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, _, b in spans:
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


FOUND = pa.schema([
    ("id", pa.int64()), ("key", pa.int64()), ("base", pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))),
    ("entities", pa.list_(pa.int64())), ("terms", pa.list_(pa.struct([("term", pa.int64()), ("start", pa.int32()), ("end", pa.int32())])))])
FOUND_SQL = "id long, key long, base array<struct<start int, kind int, end int>>, entities array<long>, terms array<struct<term long, start int, end int>>"


def find_base(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Base spans of every row, and for rows with any also their entities and terms."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, key, t in zip(*(c.to_pylist() for c in b.columns), strict=True):
                base = base_spans(t)
                rows.append({
                    "id": i, "key": key, "base": [{"start": x, "kind": k, "end": y} for x, k, y in base], "entities": sorted({entity(t, s) for s in base}),
                    "terms": [{"term": _hash(w), "start": x, "end": y} for w, x, y in terms(t, base)] if base else []})
            yield pa.RecordBatch.from_pylist(rows, schema=FOUND)

    rows = df.select(F.col(doc_id).cast("long").alias("id"), row_key(F.col(doc_id), F.col(text)).alias("key"), F.col(text).alias("t"))
    return rows.mapInArrow(find, FOUND_SQL)


def bit_table(hashes: DataFrame) -> bytes:
    """2**BITS bits, those of the ``term`` hashes set; at most 2**(BITS - 6) words come to the driver."""
    place = F.col("term").bitwiseAND(F.lit(2**BITS - 1))
    words = hashes.select(F.shiftright(place, 6).cast("int").alias("w"), F.expr("shiftleft(1L, cast(term & 63 as int))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b"))
    table = np.zeros(2 ** (BITS - 6), np.int64)
    for r in words.collect():
        table[r["w"]] = r["b"]
    return table.tobytes()


def count_terms(df: DataFrame, text: str, table: bytes) -> DataFrame:
    """(term, df) over all rows, for the terms whose bit is set."""
    shared = df.sparkSession.sparkContext.broadcast(table)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, known, total = shared.value, {}, Counter()

        def wanted(word: str) -> int | None:
            if len(known) >= 400_000:
                known.clear()
            h = _hash(word)
            at = h & (2**BITS - 1)
            known[word] = h = h if bits[at >> 3] >> (at & 7) & 1 else None
            return h

        def flush() -> pa.RecordBatch:
            out = pa.record_batch({"term": pa.array(total.keys(), pa.int64()), "n": pa.array(total.values(), pa.int64())})
            total.clear()
            return out

        for b in batches:
            for t in b.column(0).to_pylist():
                if t:
                    hits = [known[w] if w in known else wanted(w) for w in set(TERM.findall(t.lower()))]
                    total.update(h for h in hits if h is not None)
            if len(total) > 200_000:
                yield flush()
        yield flush()

    return df.select(F.col(text).alias("t")).mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("df_t"))


def disclosures(df: DataFrame, text: str, found: DataFrame, min_joint: int = MIN_JOINT, prior: int = PRIOR) -> tuple[DataFrame, DataFrame]:
    """(id, key, entity, term) for the terms of rows with an entity; (entity, term, share) of what pairs disclose, share of IC."""
    held = found.filter(F.size("entities") > 0).select("id", "key", F.explode("entities").alias("entity"), F.array_distinct(F.col("terms.term")).alias("terms"))
    often = held.groupBy("entity").agg(F.count("*").alias("df_e")).filter(F.col("df_e") >= min_joint)
    beside = held.join(often.select("entity"), "entity", "left_semi").select("id", "key", "entity", F.explode("terms").alias("term"))
    joint = materialise(beside.groupBy("entity", "term").agg(F.count("*").alias("joint")).filter(F.col("joint") >= min_joint), "joint", "zstd")
    counted = count_terms(df, text, bit_table(joint.select("term")))
    n = found.count()
    ic = -F.log2(F.col("df_e") / F.lit(float(max(n, 1))))
    pmi = F.log2(F.col("joint") * F.lit(float(n)) / (F.col("df_e") * (F.col("df_t") + prior)))
    share = joint.join(counted, "term").join(often, "entity").filter(ic > 0).select("entity", "term", (pmi / ic).alias("share"))
    return beside, share


@pandas_udf(StringType())
def _joined(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """All spans of a row as text: kind:start:end by start, then kind."""
    for base, places, flagged in batches:
        out = []
        for spans, words, flags in zip(base, places, flagged, strict=True):
            every = [(s["start"], s["kind"], s["end"]) for s in spans]
            if flags is not None and len(flags):
                kind = {f["term"]: BASE + int(f["remove"]) for f in flags}
                every += [(w["start"], kind[w["term"]], w["end"]) for w in words if w["term"] in kind]
            out.append(",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(every)))
        yield pd.Series(out, dtype=object)


def private_spans(df: DataFrame, doc_id: str = "doc_id", text: str = "text", min_joint: int = MIN_JOINT, generalise: float = GENERALISE, remove: float = REMOVE, prior: int = PRIOR) -> DataFrame:
    """(id, key, base, spans) per row: base spans as an array, and all spans as text."""
    found = materialise(find_base(df, doc_id, text), "found", "zstd")
    beside, share = disclosures(df, text, found, min_joint, prior)
    telling = share.filter(F.col("share") >= generalise).select("entity", "term", (F.col("share") >= remove).alias("remove"))
    flagged = beside.join(telling, ["entity", "term"]).groupBy("id", "key", "term").agg(F.max("remove").alias("remove"))
    flagged = flagged.groupBy("id", "key").agg(F.collect_list(F.struct("term", "remove")).alias("flags")).select(F.col("id").alias("f_id"), F.col("key").alias("f_key"), "flags")
    rows = found.join(flagged, F.col("id").eqNullSafe(F.col("f_id")) & (F.col("key") == F.col("f_key")), "left")
    return rows.select("id", "key", "base", _joined("base", "terms", "flags").alias("spans"))


@pandas_udf(StringType())
def redacted(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Text with its spans replaced by a tag of the kind, or taken out; overlapping spans give the first one's tag."""
    for texts, spans in batches:
        out = []
        for t, every in zip(texts, spans, strict=True):
            parts, at = [], 0
            for span in every.split(",") if t and every else []:
                kind, a, b = span.split(":")
                if int(a) >= at:
                    parts += [t[at : int(a)], ENTITY_TAG[kind]]
                at = max(at, int(b))
            out.append("".join(parts) + (t or "")[at:])
        yield pd.Series(out, dtype=object)


def sanitise(df: DataFrame, doc_id: str = "doc_id", text: str = "text", into: str = "sanitised", **options) -> DataFrame:
    """``df`` with the text in which personal data is replaced, telling terms are generalised or removed."""
    spans = private_spans(df, doc_id, text, **options).select(F.col("id").alias("_p_id"), F.col("key").alias("_p_key"), F.col("spans").alias("_p_spans")).distinct()
    own = df.withColumn("_key", row_key(F.col(doc_id), F.col(text)))
    joined = own.join(spans, own[doc_id].eqNullSafe(F.col("_p_id")) & (F.col("_key") == F.col("_p_key")))
    return joined.withColumn(into, redacted(F.col(text), F.col("_p_spans"))).select(*df.columns, into)
