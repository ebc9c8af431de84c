"""Filling of missing and extreme values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.encoders import column_quantiles
from tessera.operators.ranges import group_quantiles
from tessera.session import cut_lineage


def ages_to_usual(df: DataFrame, c: str) -> DataFrame:
    """Under 18 to the mean of 18-30, over 100 to the mean of 30-100, null to the median, rounded."""
    def mean_of(low, high):
        return df.where(F.col(c).between(low, high)).agg(F.avg(c)).scalar()

    fixed = df.withColumn(
        c, F.when(F.col(c) < 18, mean_of(18, 30)).when(F.col(c) > 100, mean_of(30, 100)).otherwise(F.col(c))
    )
    median = group_quantiles(fixed.select(c), [], c, {"m": 0.5}).scalar()
    return fixed.withColumn(c, F.round(F.coalesce(c, median)))


def fill_group_median(df: DataFrame, group: str, c: str) -> DataFrame:
    """Null to the median of the group, then to the median of the filled column."""
    medians = group_quantiles(df, [group], c, {"__m": 0.5})
    filled = cut_lineage(df.join(medians, group, "left").withColumn(c, F.coalesce(c, "__m")).drop("__m"))
    overall = group_quantiles(filled.select(c), [], c, {"m": 0.5}).scalar()
    return filled.withColumn(c, F.coalesce(c, overall))


def fill_minimum(df: DataFrame, c: str) -> DataFrame:
    return df.withColumn(c, F.coalesce(c, df.agg(F.min(c)).scalar()))


def above_centre(df: DataFrame, columns: Sequence[str]) -> list[Column]:
    """0/1 columns: above the median and above the mean of the table, two passes for all columns."""
    medians = column_quantiles(df, columns, {"m": 0.5})
    means = df.agg(*[F.avg(c).alias(c) for c in columns]).first()
    out = []
    for c in columns:
        out += [(F.col(c) > F.lit(medians[c]["m"])).cast("int").alias(f"{c}_above_median"),
                (F.col(c) > F.lit(means[c])).cast("int").alias(f"{c}_above_mean")]
    return out


def cap_by_class(df: DataFrame, c: str, label: str) -> Column:
    """Cap at the maximum of class 1 plus two of its standard deviations."""
    one = df.where(F.col(label) == 1)
    cap = one.agg(F.max(c) + 2 * F.stddev_samp(c)).scalar()
    return F.least(F.col(c), cap)


def fold_mean_fill(df: DataFrame, columns: Sequence[str], fold: str) -> DataFrame:
    """Fill nulls of each fold with the mean of the other folds: all less the own, from one grouped pass."""
    own = df.groupBy(fold).agg(
        *[F.sum(c).alias(f"__s_{c}") for c in columns], *[F.count(c).alias(f"__n_{c}") for c in columns]
    )
    # one row per fold
    every = Window.partitionBy()
    means = own.select(F.col(fold).alias("__fold"), *[
        F.try_divide(
            F.sum(f"__s_{c}").over(every) - F.coalesce(f"__s_{c}", F.lit(0.0)), F.sum(f"__n_{c}").over(every) - F.col(f"__n_{c}")
        ).alias(f"__m_{c}") for c in columns
    ])
    joined = df.join(means, F.col(fold).eqNullSafe(F.col("__fold")))
    return joined.select(*[
        F.coalesce(F.col(c), F.col(f"__m_{c}")).alias(c) if c in columns else F.col(c) for c in df.columns
    ])
