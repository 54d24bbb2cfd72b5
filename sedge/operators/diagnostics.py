"""Fit metrics, distribution shift, agreement and histograms."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, functions as F

from sedge.functions.numbers import finite_or_null
from sedge.operators.ordering import attach


def _rmse(y: Column, p: Column) -> Column:
    return F.sqrt(F.avg(F.pow(y - p, F.lit(2.0))))


def _r2(y: Column, p: Column) -> Column:
    """1 - residual / total; a constant target gives 1 when hit exactly, else 0."""
    left = F.sum(F.pow(y - p, F.lit(2.0)))
    total = F.var_pop(y) * F.count(y)
    return F.when(total > 0, 1 - left / F.when(total > 0, total)).otherwise(F.when(left == 0, 1.0).otherwise(0.0))


def regression_metrics(df: DataFrame, y: str, prediction: str, keys: Sequence[str] = ()) -> DataFrame:
    """RMSE, R2 and row count per group, in one pass; fits are judged on rows that have both numbers."""
    known = finite_or_null(y).isNotNull() & finite_or_null(prediction).isNotNull()
    a, b = (F.when(known, F.col(c).cast("double")) for c in (y, prediction))
    return df.groupBy(*keys).agg(_rmse(a, b).alias("rmse"), _r2(a, b).alias("r2"), F.count("*").alias("n"))


def distribution_shift(
    df: DataFrame, columns: Sequence[str], split: str = "split", first: str = "test", second: str = "validation"
) -> DataFrame:
    """Rows ``(metric, value)``: mean difference and deviation ratio of each column between two splits."""
    at = lambda c, s: F.when(F.col(split) == s, finite_or_null(c))
    means = [(f"{c}_mean_diff", F.avg(at(c, first)) - F.avg(at(c, second))) for c in columns]
    ratios = [
        (f"{c}_std_ratio", F.stddev_samp(at(c, second)) / (F.stddev_samp(at(c, first)) + F.lit(1e-9)))
        for c in columns
    ]
    wide = df.agg(*[v.alias(n) for n, v in [*means, *ratios]])
    return wide.unpivot([], wide.columns, "metric", "value")


def correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson correlation of every column pair as rows ``(left, right, corr)``, in one pass."""
    pairs = list(combinations(columns, 2))
    wide = df.agg(*[F.corr(finite_or_null(a), finite_or_null(b)).alias(f"p{i}") for i, (a, b) in enumerate(pairs)])
    rows = [
        F.struct(F.lit(a).alias("left"), F.lit(b).alias("right"), F.col(f"p{i}").alias("corr"))
        for i, (a, b) in enumerate(pairs)
    ]
    return wide.select(F.inline(F.array(*rows)))


def histogram(df: DataFrame, column: str, bins: int = 30, keys: Sequence[str] = ()) -> DataFrame:
    """Counts of ``bins`` equal bins over each group's own range; the last bin includes the maximum. NaN is in no bin."""
    x = finite_or_null(column)
    low, high = F.min(x), F.max(x)
    edges = df.groupBy(*keys).agg(
        F.when(low < high, low).otherwise(low - 0.5).alias("_lo"),
        F.when(low < high, high).otherwise(high + 0.5).alias("_hi"),
    )
    if keys:
        placed = attach(df.where(x.isNotNull()), edges, keys)
    else:
        box = edges.select(F.struct("_lo", "_hi").alias("b")).scalar()
        placed = df.where(x.isNotNull()).withColumn("_b", box).withColumns({"_lo": F.col("_b._lo"), "_hi": F.col("_b._hi")})
    raw = F.floor((x - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * bins)
    binned = placed.withColumn("bin", F.least(raw, F.lit(bins - 1)).cast("int"))
    counted = binned.groupBy(*keys, "bin", "_lo", F.col("_hi")).agg(F.count("*").alias("n"))
    left = F.col("_lo") + F.col("bin") * (F.col("_hi") - F.col("_lo")) / bins
    return counted.select(*keys, "bin", left.alias("left_edge"), "n")
