"""One-pass statistics: correlation, selection, z-scores, weights, AUC, lift."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbline.operators.ranking import pct_rank, value_ranks


def pearson(x, y) -> Column:
    """Correlation as an aggregate; null when either column is constant."""
    x, y = (F.col(c) if isinstance(c, str) else c for c in (x, y))
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def attach(df: DataFrame, one_row: DataFrame, name: str = "_s") -> DataFrame:
    """Add a one-row table as a struct column; it is evaluated once as a scalar."""
    return df.withColumn(name, one_row.select(F.struct(*one_row.columns)).scalar())


def sqrt_clip(x) -> Column:
    x = F.col(x) if isinstance(x, str) else x
    return F.when(x.isNotNull(), F.sqrt(F.greatest(x, F.lit(0.0))))


def feature_correlations(df: DataFrame, features: list[str], target: str) -> DataFrame:
    """One row: the correlation of every feature with the target, 0 for a constant feature."""
    return df.agg(*[F.coalesce(pearson(f, target), F.lit(0.0)).alias(f) for f in features])


def select_features(correlations: DataFrame, features: list[str]) -> DataFrame:
    """(feature, r, threshold, selected): keep |r| at or above the mean |r|; none means all."""
    mean_abs = sum(F.abs(F.col(f)) for f in features) / F.lit(float(len(features)))
    long = correlations.withColumn("threshold", mean_abs).select(
        "threshold",
        F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("r")) for f in features])).alias("e"),
    ).select("e.feature", "e.r", "threshold")
    return long.withColumn("selected", F.abs("r") >= F.col("threshold"))


def zscore(value, mean, sd) -> Column:
    """Population z-score; a constant column gives 0."""
    return (value - mean) / F.coalesce(F.nullif(sd, F.lit(0.0)), F.lit(1.0))


def group_weight(r: Column, total: Column) -> Column:
    """1 + share of |r| rounded to three places; 1 when undefined."""
    share = F.bround(F.try_divide(F.abs(r), total), 3)
    return F.lit(1.0) + F.coalesce(share, F.lit(0.0))


def auc(df: DataFrame, score: str, label: str) -> DataFrame:
    """Area under the ROC curve from average ranks (Mann–Whitney), as one row ``auc``."""
    per = df.filter(F.col(score).isNotNull()).groupBy(score).agg(
        F.count("*").alias("c"), F.sum(F.col(label)).alias("p")
    )
    ranks = value_ranks(df, score)
    avg_rank = F.col("below") + (F.col("cnt") + 1) / 2
    joined = ranks.join(per, score)
    return joined.agg(
        F.sum(F.col("p") * avg_rank).alias("rs"), F.sum("p").alias("pos"), F.sum(F.col("c") - F.col("p")).alias("neg")
    ).select(
        F.try_divide(F.col("rs") - F.col("pos") * (F.col("pos") + 1) / 2, F.col("pos") * F.col("neg")).alias("auc")
    )


def lift(df: DataFrame, chosen: str, label: str) -> DataFrame:
    """Label rate among the chosen rows divided by the overall rate, as one row ``lift``."""
    return df.agg(
        F.try_divide(F.avg(F.when(F.col(chosen), F.col(label).cast("double"))), F.avg(F.col(label).cast("double"))).alias("lift")
    )


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """Rank correlation from average ranks, as one row ``rho``."""
    ranked = pct_rank(pct_rank(df, a, "_pa"), b, "_pb")
    return ranked.agg(pearson("_pa", "_pb").alias("rho"))


def score_distribution(df: DataFrame, score: str, high: float = 0.8, inclusive: bool = True) -> DataFrame:
    """mean, median, p25, p75, p95, n_zero, n_high, n_null as one row."""
    from kerbline.operators.ranking import quantiles

    s = F.col(score)
    basics = df.agg(
        F.avg(s).alias("mean"), F.count_if(s == 0).alias("n_zero"),
        F.count_if(s >= high if inclusive else s > high).alias("n_high"), F.count_if(s.isNull()).alias("n_null"),
    )
    qs = quantiles(df, score, [0.25, 0.5, 0.75, 0.95], ["p25", "median", "p75", "p95"])
    return attach(basics, qs).select(
        "mean", "_s.median", "_s.p25", "_s.p75", "_s.p95", "n_zero", "n_high", "n_null"
    )
