"""Ranks, quantiles and top-k over whole tables without a single-task sort.

Equal values are counted first, so a hot value is one row from then on. The distinct values are
cut into ranges at approximate quantiles; range totals (a table of fixed size) give each range its
offset, and running counts inside a range finish the exact rank.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANGES = 64


def _cuts(values: DataFrame, column: str, ranges: int) -> list:
    """Points that cut ``values`` into about ``ranges`` equal parts: approximate quantiles of numbers; of texts, from the
    64 per range with the smallest hashes."""
    if dict(values.dtypes)[column] != "string":
        row = values.agg(F.percentile_approx(column, [i / ranges for i in range(1, ranges)], 1000)).first()
        return sorted(set(row[0] or []))
    few = values.filter(F.col(column).isNotNull()).select(column).orderBy(F.xxhash64(column)).limit(64 * ranges).collect()
    few = sorted({r[0] for r in few}, key=str.encode)
    return sorted({few[len(few) * i // ranges] for i in range(1, ranges)}, key=str.encode) if few else []


def _with_range(df: DataFrame, values: DataFrame, column: str, out: str, ranges: int) -> DataFrame:
    """Add the index of the range that ``column`` falls in, with cuts taken from ``values``.

    The cuts are at most ``ranges`` values; the index is a tree of comparisons.
    """
    key, cuts = F.col(column), _cuts(values, column, ranges)

    def branch(lo: int, hi: int) -> Column:
        """Number of cuts at or below the key, given that it is from ``lo`` to ``hi``."""
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(key < cuts[mid], branch(lo, mid)).otherwise(branch(mid + 1, hi))

    return df.withColumn(out, branch(0, len(cuts)))


def value_ranks(df: DataFrame, column: str, by: list[str] = (), ranges: int = RANGES) -> DataFrame:
    """One row per distinct value (and group): ``cnt``, ``below`` (rows with a smaller value), ``total``."""
    by = list(by)
    values = df.filter(F.col(column).isNotNull()).groupBy(*by, column).agg(F.count("*").alias("cnt"))
    ranged = _with_range(values, values, column, "_r", ranges)
    totals = ranged.groupBy(*by, "_r").agg(F.sum("cnt").alias("_c"))
    order = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    offsets = totals.select(
        *by, "_r",
        (F.sum("_c").over(order.orderBy("_r").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_c")).alias("_off"),
        F.sum("_c").over(order).alias("total"),
    )
    inside = Window.partitionBy(*by, "_r").orderBy(column).rowsBetween(Window.unboundedPreceding, 0)
    return (
        ranged.join(offsets, [*by, "_r"])
        .withColumn("below", F.col("_off") + F.sum("cnt").over(inside) - F.col("cnt"))
        .select(*by, column, "cnt", "below", "total")
    )


def pct_rank(df: DataFrame, column: str, out: str, by: list[str] = (), ranges: int = RANGES) -> DataFrame:
    """Average-rank percentile in (0, 1]; null values get null."""
    by = list(by)
    ranks = value_ranks(df, column, by, ranges).select(
        *[F.col(b).alias(f"_k_{b}") for b in by],
        F.col(column).alias("_v"),
        ((F.col("below") + (F.col("cnt") + 1) / 2) / F.col("total")).alias(out),
    )
    on = F.col(column) == F.col("_v")
    for b in by:
        on = on & F.col(b).eqNullSafe(F.col(f"_k_{b}"))
    return df.join(ranks, on, "left").drop("_v", *[f"_k_{b}" for b in by])


def row_numbers(df: DataFrame, column: str, tie: str, out: str, ranges: int = RANGES) -> DataFrame:
    """Exact position 1..n by (column, tie), plus ``_n``, the number of rows with a value; both null without one.

    Rows of one hot value are themselves cut by ranges of the tie-breaker.
    """
    ranks = value_ranks(df, column, (), ranges).select(F.col(column).alias("_v"), "below", F.col("total").alias("_n"))
    ties = df.groupBy(tie).agg(F.count("*").alias("_x"))
    missing = df.filter(F.col(column).isNull())
    base = df.filter(F.col(column).isNotNull()).join(ranks, F.col(column) == F.col("_v")).drop("_v")
    base = _with_range(base, ties, tie, "_t", ranges)
    counts = base.groupBy(column, "_t").agg(F.count("*").alias("_c"))
    w = Window.partitionBy(column).orderBy("_t").rowsBetween(Window.unboundedPreceding, 0)
    counts = counts.select(F.col(column).alias("_v"), F.col("_t").alias("_tt"), (F.sum("_c").over(w) - F.col("_c")).alias("_o"))
    base = base.join(counts, (F.col(column) == F.col("_v")) & (F.col("_t") == F.col("_tt")))
    inner = Window.partitionBy(column, "_t").orderBy(tie)
    numbered = base.withColumn(out, F.col("below") + F.col("_o") + F.row_number().over(inner)).drop("_v", "_tt", "_t", "_o", "below")
    return numbered.unionByName(missing, allowMissingColumns=True)


def deciles(df: DataFrame, column: str, tie: str, out: str = "decile", q: int = 10) -> DataFrame:
    """Equal-count bins 1..q of the position by (column, tie), with edges at linear quantiles."""
    ranked = row_numbers(df, column, tie, "_pos")
    return ranked.withColumn(
        out, F.when(F.col("_n").isNull(), F.lit(None)).when(F.col("_n") <= 1, F.lit(1)).otherwise(
            F.greatest(F.lit(1), F.ceil((F.col("_pos") - 1) * q / (F.col("_n") - 1)).cast("int"))
        ),
    ).drop("_pos", "_n")


def quantiles(df: DataFrame, column: str, probs: list[float], names: list[str], by: list[str] = (), ranges: int = RANGES) -> DataFrame:
    """Exact linear-interpolation quantiles, one row (per group)."""
    by = list(by)
    ranks = value_ranks(df, column, by, ranges)
    aggs = []
    for p, name in zip(probs, names):
        pos = (F.col("total") - 1) * F.lit(float(p))
        for suffix, at in (("lo", F.floor(pos)), ("hi", F.ceil(pos))):
            here = (F.col("below") <= at) & (at < F.col("below") + F.col("cnt"))
            aggs.append(F.max(F.when(here, F.col(column))).alias(f"_{name}_{suffix}"))
    aggs.append(F.max("total").alias("_n"))
    found = ranks.groupBy(*by).agg(*aggs) if by else ranks.agg(*aggs)
    out = []
    for p, name in zip(probs, names):
        pos = (F.col("_n") - 1) * F.lit(float(p))
        lo, hi = F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
        out.append((lo + (hi - lo) * (pos - F.floor(pos))).alias(name))
    return found.select(*by, *out)


def first_per_key(df: DataFrame, keys: list[str], order: list[Column], keep: list[str]) -> DataFrame:
    """The first row of each key by ``order`` as a map-side combined minimum, never a sorted group."""
    rank = [c.alias(f"_o{i}") for i, c in enumerate(order)]
    best = df.groupBy(*keys).agg(F.min(F.struct(*rank, *keep)).alias("_b"))
    return best.select(*keys, *[f"_b.{c}" for c in keep])


def top_k(df: DataFrame, k: int, *order: Column) -> DataFrame:
    """The k first rows (kept per partition before merging)."""
    return df.orderBy(*order).limit(k)
