"""Language identification by compression with per-language raw-content dictionaries.

For every language a dictionary of raw text is gathered from labelled rows. A text is compressed with
zstandard once per language; the language whose dictionary gives the fewest bytes wins. Texts are cut
into blocks, each compressed on its own with the dictionary, so that the dictionary matters throughout
a long text and no part of the text is left out. A text whose best and second-best sizes are close
is rejected.

Nulls, texts without any letter, and every text when nothing was learned give ``und``, score 0, rejected.
Ties go to the language that sorts first. Repeated rows are predicted one by one, alike.
"""

from __future__ import annotations

import re

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructType

from kerbline.llm.texts import hash_below, with_columns

SAMPLE_TEXTS = 256  # texts per language that the dictionaries are made from, at most
PIECE_CHARS = 256  # taken from each of them, at a place given by the text's hash
DICTIONARY_BYTES = 49_152
BLOCK = 16_384
LEVEL = 6
MIN_MARGIN = 0.01
LETTER = regex.compile(r"\p{L}")
GAP = re.compile(r"[\W\d_]+")


def plain(text: str) -> str:
    """Lower-case letters with single spaces for all else: capitals, figures and marks say little about a language."""
    return GAP.sub(" ", text.lower())


def learn(df: DataFrame, text: str, lang: str, sample: int = SAMPLE_TEXTS, piece: int = PIECE_CHARS) -> dict[str, bytes]:
    """Dictionary bytes per language, from at most ``sample`` pieces of distinct texts of each.

    The sample is the texts with the smallest hashes; only the pieces come to the driver, so their
    size is bounded by languages x ``sample`` x ``piece`` however large ``df`` is.
    """
    rows = df.select(F.col(text).alias("t"), F.col(lang).alias("l")).filter(F.col("l").isNotNull() & F.col("t").rlike(r"\p{L}"))
    sizes = {r["l"]: r["n"] for r in rows.groupBy("l").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return {}
    wanted = F.create_map(*[F.lit(x) for name, n in sizes.items() for x in (name, min(1.0, 4.0 * sample / n))])
    hashed = F.xxhash64("t")
    few = rows.filter(hash_below(hashed, F.element_at(wanted, F.col("l")))).select(
        "l", hashed.alias("h"), F.substring(F.col("t"), (F.pmod(hashed, F.greatest(F.length("t") - piece, F.lit(0)) + 1) + 1).cast("int"), F.lit(piece)).alias("p"))
    few = few.groupBy("l", "h").agg(F.min("p").alias("p"))  # copies count once
    first = few.groupBy("l").agg(F.slice(F.array_sort(F.collect_list(F.struct("h", "p"))), 1, sample).alias("s"))
    return {r["l"]: plain(" ".join(x["p"] for x in r["s"])).encode()[-DICTIONARY_BYTES:] for r in first.collect()}


class Compressors:
    """One compressor per language, in the order of the languages."""

    def __init__(self, dictionaries: dict[str, bytes]):
        self.names = sorted(dictionaries)
        self.by = []
        for name in self.names:
            raw = zstandard.ZstdCompressionDict(dictionaries[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            raw.precompute_compress(level=LEVEL)
            self.by.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=raw, write_checksum=False, write_content_size=False, write_dict_id=False))

    def sizes(self, text: str) -> list[int]:
        data = plain(text).encode("utf-8", "surrogatepass")
        blocks = [data[i : i + BLOCK] for i in range(0, len(data), BLOCK)]
        return [sum(len(c.compress(b)) for b in blocks) for c in self.by]

    def predict(self, text: str | None, min_margin: float) -> tuple[str, float, bool]:
        if not text or not self.names or not LETTER.search(text):
            return "und", 0.0, True
        sizes = self.sizes(text)
        best = min(range(len(sizes)), key=sizes.__getitem__)
        if len(sizes) == 1:
            return self.names[0], 1.0, False
        second = min(s for i, s in enumerate(sizes) if i != best)
        margin = 1 - sizes[best] / second
        return self.names[best], margin, margin < min_margin


def identify(df: DataFrame, text: str, dictionaries: dict[str, bytes], min_margin: float = MIN_MARGIN, into: str = "language") -> DataFrame:
    """``df`` with a struct column ``into`` (lang_pred, score, rejected); score is the relative margin in bytes. No shuffle."""
    kept: list[Compressors] = []

    def fill(p: pa.RecordBatch) -> dict[str, list]:
        if not kept:
            kept.append(Compressors(dictionaries))
        found = [kept[0].predict(t, min_margin) for t in p.column(text).to_pylist()]
        return {into: [dict(zip(("lang_pred", "score", "rejected"), x, strict=True)) for x in found]}

    arrow = pa.struct([("lang_pred", pa.string()), ("score", pa.float64()), ("rejected", pa.bool_())])
    return with_columns(df, {into: (arrow, StructType().add("lang_pred", StringType()).add("score", DoubleType()).add("rejected", BooleanType()))}, fill)
