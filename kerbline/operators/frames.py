"""Filters, projections, imputation and set operations on whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbline.operators.ranking import quantiles
from kerbline.operators.stats import attach


def require_columns(df: DataFrame, names: list[str]) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def valid_coords(df: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """Rows with non-null, non-zero coordinates."""
    return df.filter(F.col(x).isNotNull() & F.col(y).isNotNull() & (F.col(x) != 0) & (F.col(y) != 0))


def contains_in_any(df: DataFrame, columns: list[str], needle: str) -> DataFrame:
    """Rows with ``needle`` in one of the columns that exist; unchanged when none does."""
    tests = [F.coalesce(F.col(c).contains(needle), F.lit(False)) for c in columns if c in df.columns]
    if not tests:
        return df
    test = tests[0]
    for other in tests[1:]:
        test = test | other
    return df.filter(test)


def within_box(df: DataFrame, x: str, y: str, minx: float, miny: float, maxx: float, maxy: float, margin: float = 0.0) -> DataFrame:
    return df.filter(F.col(x).between(minx - margin, maxx + margin) & F.col(y).between(miny - margin, maxy + margin))


def positive_weight(df: DataFrame, column: str) -> DataFrame:
    """Rows whose ``column`` reads as a number above zero, as a double."""
    return df.withColumn(column, F.col(column).cast("string").try_cast("double")).filter(F.col(column) > 0)


def pad_missing(df: DataFrame, schema: list[tuple[str, str]]) -> DataFrame:
    """Exactly the columns of ``schema``; absent ones are null."""
    have = set(df.columns)
    return df.select(*[(F.col(n) if n in have else F.lit(None)).cast(t).alias(n) for n, t in schema])


def impute_median(df: DataFrame, column: str) -> DataFrame:
    med = quantiles(df, column, [0.5], ["m"])
    return attach(df, med, "_m").withColumn(column, F.coalesce(F.col(column), F.col("_m.m"))).drop("_m")


def flag_above_mean(df: DataFrame, column: str, out: str) -> DataFrame:
    """1 where the value exceeds the overall mean; missing values give 0."""
    mean = df.agg(F.avg(column).alias("m"))
    return attach(df, mean, "_m").withColumn(
        out, F.coalesce((F.col(column) > F.col("_m.m")).cast("int"), F.lit(0))
    ).drop("_m")


def drop_repeats(df: DataFrame, keys: list[str], order: list[str], columns: list[Column]) -> DataFrame:
    """Drop rows equal in ``columns`` to the row before them."""
    w = Window.partitionBy(*keys).orderBy(*order)
    value = F.struct(*columns)
    return df.withColumn("_prev", F.lag(value).over(w)).filter(~F.coalesce(F.col("_prev") == value, F.lit(False))).drop("_prev")


def mixed_aggregate(df: DataFrame, key: str, mean_columns: list[str], skip: list[str] = ()) -> DataFrame:
    """Per key: mean of the listed columns, maximum of every other numeric column."""
    aggs = []
    for name, kind in df.dtypes:
        if name == key or name in skip or kind not in ("double", "float", "bigint", "int", "smallint"):
            continue
        aggs.append((F.avg(name) if name in mean_columns else F.max(name)).alias(name))
    return df.groupBy(key).agg(*aggs)


def value_counts(df: DataFrame, column: str, categories: list[str]) -> DataFrame:
    """Count per category, zero where absent, plus a row for null values; other values keep their own rows."""
    counted = df.groupBy(F.coalesce(F.col(column).cast("string"), F.lit("<null>")).alias(column)).agg(F.count("*").alias("n"))
    zeros = df.sparkSession.createDataFrame([(c, 0) for c in [*categories, "<null>"]], f"{column} string, n bigint")
    return counted.unionByName(zeros).groupBy(column).agg(F.sum("n").alias("n"))


def row_sum_matching(df: DataFrame, parts: list[str], out: str) -> DataFrame:
    """Sum over the columns whose name contains one of ``parts``; nulls count as 0."""
    total = F.lit(0.0)
    for c in df.columns:
        if any(p in c for p in parts):
            total = total + F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    return df.withColumn(out, total)


def left_count(df: DataFrame, key: str, counts: DataFrame, column: str) -> DataFrame:
    """Attach a count per key, 0 where there is none."""
    return df.join(counts.select(key, column), key, "left").withColumn(column, F.coalesce(column, F.lit(0)).cast("bigint"))


def sample_per_group(df: DataFrame, group: str, id_column: str, k: int, seed: int = 42) -> DataFrame:
    """Up to ``k`` rows per group by the order of a seeded hash (the same rows on every run).

    Groups are first thinned by salt, so that no task sorts a whole group.
    """
    ranked = df.withColumn("_h", F.xxhash64(F.col(id_column), F.lit(seed)))
    ranked = ranked.withColumn("_salt", F.pmod(F.col("_h"), F.lit(32)))
    first = Window.partitionBy(group, "_salt").orderBy("_h", id_column)
    last = Window.partitionBy(group).orderBy("_h", id_column)
    return (
        ranked.withColumn("_r", F.row_number().over(first)).filter(F.col("_r") <= k)
        .withColumn("_r", F.row_number().over(last)).filter(F.col("_r") <= k)
        .drop("_h", "_salt", "_r")
    )


def edge_key(u, v) -> tuple[Column, Column]:
    """Canonical (min, max) key of an undirected edge."""
    u, v = (F.col(c) if isinstance(c, str) else c for c in (u, v))
    return F.least(u, v), F.greatest(u, v)


def jaccard(a, b) -> Column:
    """Size of the intersection of two id arrays over the size of their union."""
    a, b = (F.col(c) if isinstance(c, str) else c for c in (a, b))
    return F.size(F.array_intersect(a, b)) / F.greatest(F.size(F.array_union(a, b)), F.lit(1))


def key_differences(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys found on one side only, with the side they are on."""
    l, r = left.select(key).distinct(), right.select(key).distinct()
    return l.join(r, key, "left_anti").withColumn("side", F.lit("left")).unionByName(
        r.join(l, key, "left_anti").withColumn("side", F.lit("right"))
    )


def runs_above(df: DataFrame, keys: list[str], order: str, column: str, threshold: float) -> DataFrame:
    """Rows above the threshold with ``run``, the number of their consecutive run within the key."""
    w = Window.partitionBy(*keys).orderBy(order)
    hot = F.col(column) > threshold
    return (
        df.withColumn("_hot", F.coalesce(hot, F.lit(False)))
        .withColumn("_start", (F.col("_hot") & ~F.coalesce(F.lag("_hot").over(w), F.lit(False))).cast("int"))
        .withColumn("run", F.sum("_start").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        .filter("_hot").drop("_hot", "_start")
    )


def run_representatives(runs: DataFrame, keys: list[str], order: str, risk: str, length: str, edge: str) -> DataFrame:
    """Per run: riskiest edge (the first on ties), its risk, and the length of the run."""
    return runs.groupBy(*keys, "run").agg(
        F.max(F.struct(F.col(risk), (-F.col(order)).alias("_o"), F.col(edge))).alias("_b"),
        F.sum(length).alias("length_m"), F.count("*").alias("n_edges"),
    ).select(*keys, "run", F.col(f"_b.{edge}").alias(edge), F.col(f"_b.{risk}").alias(risk), "length_m", "n_edges")
