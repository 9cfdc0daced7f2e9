"""Exact duplicates by a tree of merged digest runs.

Every partition makes a run of (SHA-256, length, smallest or largest id, count) sorted by digest, one
record per distinct text. Runs then travel through rounds of a generalised binomial exchange: the
partitions are numbered in base ``RADIX``, and in round r a partition sends to each of the ``RADIX``
partitions that differ from it in digit r the part of its run whose digest has that digit. Receivers
merge the sorted runs and keep one record per text, so a text with any number of copies is one record
per partition from the start and fewer after each round. After the last round a partition holds the final
records of its digest range; no range, whatever its copies, is gathered anywhere before it has shrunk.

A record speaks for texts with equal digest *and* equal length. Null text counts as empty, a null id as
smaller than any other. Rows equal in id and text form a group in which exactly one row is kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RADIX = 4
CHUNK = 50_000  # records per piece of a run that is sent
NO_ID = -(2**63)
RUN = np.dtype([("sha", "S32"), ("size", "<i8"), ("id", "<i8"), ("rows", "<i8")])


def _merged(run: np.ndarray, largest: bool) -> np.ndarray:
    """One record per text of a concatenation of sorted runs; the stable sort merges runs as it finds them."""
    if not len(run):
        return run
    run = run[np.argsort(run["sha"], kind="stable")]
    if ((run["sha"][1:] == run["sha"][:-1]) & (run["size"][1:] != run["size"][:-1])).any():
        run = run[np.lexsort((run["size"], run["sha"]))]
    first = np.flatnonzero(np.r_[True, (run["sha"][1:] != run["sha"][:-1]) | (run["size"][1:] != run["size"][:-1])])
    out = run[first].copy()
    out["id"] = (np.maximum if largest else np.minimum).reduceat(run["id"], first)
    out["rows"] = np.add.reduceat(run["rows"], first)
    return out


def _digit(run: np.ndarray, place: int) -> np.ndarray:
    """The digit of each record's digest that decides round ``place``."""
    head = run["sha"].astype("S8").view(">u8") if len(run) else np.zeros(0, "u8")
    return (head.astype(np.uint64) // np.uint64(RADIX**place) % np.uint64(RADIX)).astype(int)


def _pieces(home: int, run: np.ndarray):
    for start in range(0, len(run), CHUNK):
        yield home, run[start : start + CHUNK].tobytes()


def keepers(rows: DataFrame, largest: bool, parts: int | None = None) -> DataFrame:
    """(sha binary, size, keep_id, group_size) per distinct text of ``rows`` (id long, sha binary, size long)."""
    want = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rounds = next(r for r in range(64) if RADIX**r >= want)
    total = RADIX**rounds
    extreme = NO_ID if largest else 2**63 - 1  # a null id loses to every other id
    schema = "home int, run binary"

    def start(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        home, run, held, grown = TaskContext.get().partitionId() % total, [], 0, 0
        for b in batches:
            part = np.empty(len(b), RUN)
            part["sha"] = np.frombuffer(b"".join(map(bytes, b["sha"])), "S32")
            part["size"], part["id"], part["rows"] = b["size"].to_numpy(), b["id"].to_numpy(), 1
            run.append(part)
            held += len(part)
            if held > 2 * grown + 100_000:  # merge now and then, so that copies don't pile up
                run = [_merged(np.concatenate(run), largest)]
                held = grown = len(run[0])
        yield from send(home, _merged(np.concatenate(run or [np.empty(0, RUN)]), largest), 0)

    def send(home: int, run: np.ndarray, place: int) -> Iterator[pd.DataFrame]:
        if place == rounds:
            out = list(_pieces(home, run))
        else:
            digit, step = _digit(run, place), RADIX**place
            base = home - home // step % RADIX * step
            out = [x for d in range(RADIX) for x in _pieces(base + d * step, run[digit == d])]
        yield pd.DataFrame(out, columns=["home", "run"])

    def merging(place: int):
        def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            runs: dict[int, list[np.ndarray]] = {}
            for b in batches:
                for home, run in zip(b["home"], b["run"], strict=True):
                    runs.setdefault(home, []).append(np.frombuffer(run, RUN))
            for home in sorted(runs):
                yield from send(home, _merged(np.concatenate(runs.pop(home)), largest), place)

        return merge

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for run in b["run"]:
                r = np.frombuffer(run, RUN)
                raw = r["sha"].tobytes()
                ids = pd.array(r["id"].astype("int64"), dtype="Int64")
                ids[r["id"] == extreme] = pd.NA
                yield pd.DataFrame({"sha": [raw[i : i + 32] for i in range(0, len(raw), 32)], "size": r["size"].astype("int64"), "keep_id": ids, "group_size": r["rows"].astype("int64")})

    runs = rows.select("sha", "size", F.coalesce("id", F.lit(extreme)).alias("id")).mapInPandas(start, schema)
    for place in range(1, rounds + 1):
        runs = runs.repartitionById(total, F.col("home")).mapInPandas(merging(place), schema)
    return runs.mapInPandas(unpack, "sha binary, size long, keep_id long, group_size long")


def fingerprints(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    t = F.coalesce(F.col(text), F.lit(""))
    return df.select(F.col(doc_id).cast("long").alias("id"), F.unhex(F.sha2(t, 256)).alias("sha"), F.octet_length(t).cast("long").alias("size"))


def exact_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: str = "max") -> DataFrame:
    """(id, keep_id, group_size, kept, sha) for every row of ``df``; ``keep``: ``max`` or ``min`` of the ids.

    Rows are first counted per (id, text), so rows that agree in both are told apart only when they
    are written out, and a hot digest reaches the final join as its distinct ids; adaptive execution
    splits such a key there, as its other side is one row per digest.
    """
    rows = fingerprints(df, doc_id, text)
    groups = keepers(rows, keep == "max")
    members = rows.groupBy("id", "sha", "size").agg(F.count("*").alias("same"))
    joined = members.join(groups, ["sha", "size"])
    each = joined.select("id", "sha", "keep_id", "group_size", F.explode(F.sequence(F.lit(1), F.col("same"))).alias("i"))
    return each.select("id", "keep_id", "group_size", (F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("i") == 1)).alias("kept"), "sha")


def drop_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: str = "max") -> DataFrame:
    """The rows of ``df`` that stay, with all their columns."""
    groups = keepers(fingerprints(df, doc_id, text), keep == "max").select(
        F.col("sha").alias("_g_sha"), F.col("size").alias("_g_size"), F.col("keep_id").alias("_g_id"))
    t = F.coalesce(F.col(text), F.lit(""))
    own = df.withColumn("_d_sha", F.unhex(F.sha2(t, 256)))
    near = own.join(groups, (F.col("_d_sha") == F.col("_g_sha")) & (F.octet_length(t) == F.col("_g_size")) & F.col(doc_id).eqNullSafe(F.col("_g_id")))
    nth = F.row_number().over(Window.partitionBy("_d_sha", doc_id).orderBy(F.lit(1)))
    return near.withColumn("_d_n", nth).filter("_d_n = 1").select(*df.columns)
