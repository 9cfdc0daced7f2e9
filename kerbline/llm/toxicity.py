"""Toxicity scores from non-negative positive-unlabelled learning.

Known toxic texts are the positives P, all other texts are unlabelled (U) and hold toxic ones at the
class prior ``prior``. A linear classifier over the presence of words and word stems is trained with the estimator

    prior * mean_P loss(+z) + max(0, mean_U loss(-z) - prior * mean_P loss(-z))

where the part that estimates the risk on non-toxic text is kept from falling below zero: when it
does, the step goes the other way on that part alone. The logistic loss makes sigmoid(z) the
probability of being toxic. Words are chosen by their likelihood ratio between P and U in Spark;
the driver gets lists of word numbers of a bounded sample, and numpy fits a bounded weight vector.

Null and empty texts have no words and get the score of the bias alone. With no positive rows every
score is 0. Repeated rows count as often as they occur.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, IntegerType

from kerbline.llm.texts import hash_below as _below

SAMPLE_POSITIVE = 4000  # rows the classifier is fitted on, at most about
SAMPLE_UNLABELLED = 12_000
FEATURES = 512
MIN_POSITIVE_ROWS = 3  # a word must occur in so many positives
MIN_GAIN = 15.0  # and have this log-likelihood ratio at least: by chance about one word in ten thousand has
PRIOR = 0.1  # where the labels don't tell
WORD = re.compile(r"[^\W_]+")


STEMS = range(4, 9)  # lengths of the word beginnings that are features beside whole words


def features_of(word: str) -> list[str]:
    """A word and its beginnings (marked ``~``), which stand for words of one stem."""
    return [word] + [word[:n] + "~" for n in STEMS if n < len(word)]


class Finder:
    """Which of the chosen features a text has; remembers the answer per word."""

    KEPT = 300_000

    def __init__(self, chosen):
        self.chosen, self.seen = chosen, {}

    def __call__(self, text: str | None) -> set[str]:
        out: set[str] = set()
        if text:
            seen = self.seen
            for w in set(WORD.findall(text.lower())):
                f = seen.get(w)
                if f is None:
                    if len(seen) >= self.KEPT:
                        seen.clear()
                    f = seen[w] = tuple(x for x in features_of(w) if x in self.chosen)
                out.update(f)
        return out


def count_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(feature, p, u): in how many positive and other texts each feature occurs, summed over batches."""
    p, u = Counter(), Counter()

    def flush() -> Iterator[pa.RecordBatch]:
        names = list(p.keys() | u.keys())
        for i in range(0, len(names), 100_000):
            part = names[i : i + 100_000]
            yield pa.record_batch({"word": pa.array(part, pa.string()), "p": pa.array([p[x] for x in part], pa.int64()), "u": pa.array([u[x] for x in part], pa.int64())})
        p.clear()
        u.clear()

    for b in batches:
        for text, pos in zip(b.column("t").to_pylist(), b.column("pos").to_pylist(), strict=True):
            (p if pos else u).update({f for w in set(WORD.findall((text or "").lower())) for f in features_of(w)})
            if len(u) + len(p) > 500_000:
                yield from flush()
    yield from flush()


def numbers_of(number: dict[str, int]):
    """A vectorised function text -> numbers of the chosen features in it."""

    @pandas_udf(ArrayType(IntegerType()))
    def numbers(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        find = Finder(number.keys())
        for texts in batches:
            yield pd.Series([[number[f] for f in find(t)] for t in texts], dtype=object)

    return numbers


def learn(df: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic", prior: float | None = None) -> dict:
    """Fit on the rows of ``df``; ``labels`` says of some ids whether they are toxic (1) or not (0).

    Rows are drawn by a hash of their id before any text is touched. The draw has at most about
    ``SAMPLE_POSITIVE`` + ``SAMPLE_UNLABELLED`` ids, and never more than twice as many, so it is broadcast.
    """
    known = labels.groupBy(F.col(doc_id).alias("i")).agg(F.max(toxic).alias("toxic"))
    ids = df.select(F.col(doc_id).alias("i"), F.xxhash64(doc_id, F.lit(7)).alias("h")).join(known, "i", "left")
    marks = ids.agg(F.count(F.when(F.col("toxic") == 1, 1)).alias("p"), F.count(F.when(F.col("toxic") == 0, 1)).alias("n"), F.count("*").alias("all")).first()
    if not marks["p"]:
        return {"words": {}, "bias": -50.0}
    if prior is None:
        prior = marks["p"] / (marks["p"] + marks["n"]) if marks["n"] else PRIOR
    share = lambda want, have: F.lit(min(1.0, want / max(1, have)))
    is_toxic = F.coalesce(F.col("toxic") == 1, F.lit(False))
    drawn = ids.select("i", F.posexplode(F.array(
        is_toxic & _below("h", share(SAMPLE_POSITIVE, marks["p"])), _below("h", share(SAMPLE_UNLABELLED, marks["all"])))).alias("role", "in"), is_toxic.alias("known"))
    drawn = drawn.filter("in").select("i", (F.col("role") == 0).alias("pos"), "known").distinct().limit(2 * (SAMPLE_POSITIVE + SAMPLE_UNLABELLED))
    sample = df.join(F.broadcast(drawn), F.col(doc_id) == F.col("i")).select("pos", "known", F.col(text).alias("t")).persist()
    try:
        sizes = {r["pos"]: r["n"] for r in sample.filter("pos = known").groupBy("pos").agg(F.count("*").alias("n")).collect()}
        n_p, n_u = max(1, sizes.get(True, 0)), max(1, sizes.get(False, 0))  # U without the known positives
        counts = (
            sample.filter("pos = known").select("t", "pos").mapInArrow(count_features, "word string, p long, u long")
            .groupBy("word").agg(F.sum("p").cast("double").alias("p"), F.sum("u").cast("double").alias("u")))
        # log-likelihood ratio of "the word is as frequent in P as in U" against "it is not"
        rate = (F.col("p") + F.col("u")) / (n_p + n_u)
        part = lambda seen, expected: F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)
        gain = 2 * (part(F.col("p"), n_p * rate) + part(F.col("u"), n_u * rate) + part(n_p - F.col("p"), n_p * (1 - rate)) + part(n_u - F.col("u"), n_u * (1 - rate)))
        chosen = counts.filter(F.col("p") >= MIN_POSITIVE_ROWS).select("word", gain.alias("g")).filter(F.col("g") >= MIN_GAIN).orderBy(F.desc("g"), "word").limit(FEATURES).collect()
        number = {r["word"]: i for i, r in enumerate(chosen)}
        lists = sample.select("pos", numbers_of(number)("t").alias("f")).collect()
    finally:
        sample.unpersist()
    x = np.zeros((len(lists), len(number)), np.float32)
    for i, r in enumerate(lists):
        x[i, r["f"]] = 1
    positives = np.array([r["pos"] for r in lists], bool)
    weights, bias = fit(x[positives], x[~positives], prior)
    return {"words": {w: float(weights[i]) for w, i in number.items()}, "bias": float(bias)}


def fit(p: np.ndarray, u: np.ndarray, prior: float, rounds: int = 400, rate: float = 0.05, ridge: float = 1e-4, beta: float = 0.0) -> tuple[np.ndarray, float]:
    """Weights and bias of the non-negative positive-unlabelled risk, by Adam on all rows."""
    w, b = np.zeros(p.shape[1], np.float32), np.float32(-1)
    m, v = np.zeros(len(w) + 1, np.float32), np.zeros(len(w) + 1, np.float32)
    if not len(p) or not len(u):
        return w, -50.0
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    soft = lambda z: np.logaddexp(0, z)
    for step in range(1, rounds + 1):
        zp, zu = p @ w + b, u @ w + b
        negative = soft(zu).mean() - prior * soft(zp).mean()
        gp, gu = sigmoid(zp) / len(p), sigmoid(zu) / len(u)  # slopes of mean loss(-z)
        if negative < -beta:  # the estimate went below zero: undo that part only
            to_p, to_u = prior * gp, -gu
        else:
            to_p, to_u = prior * (gp - 1 / len(p)) - prior * gp, gu
        to_p, to_u = to_p.astype(np.float32), to_u.astype(np.float32)
        grad = np.append(p.T @ to_p + u.T @ to_u + ridge * w, to_p.sum() + to_u.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return w, b


def scorer(model: dict):
    """A vectorised function text -> probability of being toxic."""

    @pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        weight, bias = model["words"], model["bias"]
        find = Finder(weight.keys())
        for texts in batches:
            z = np.array([bias + math.fsum(map(weight.__getitem__, find(t))) for t in texts], float)
            yield pd.Series(1 / (1 + np.exp(-np.clip(z, -40, 40))))

    return score
