"""Blends of prediction columns or prediction tables."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.ranges import average_rank


def weighted_mean(columns: Sequence[Column], weights: Sequence[float] | None = None) -> Column:
    weights = list(weights or [1.0] * len(columns))
    total = reduce(lambda a, b: a + b, [c * w for c, w in zip(columns, weights)])
    return total / sum(weights)


def row_median(columns: Sequence[Column]) -> Column:
    n = len(columns)
    ordered = F.array_sort(F.array(*columns))
    return (ordered[(n - 1) // 2] + ordered[n // 2]) / 2


def log_mean(columns: Sequence[Column], weights: Sequence[float] | None = None) -> Column:
    """Weighted geometric mean."""
    return F.exp(weighted_mean([F.log(c) for c in columns], weights))


def rank_mean(df: DataFrame, key: str, columns: Sequence[str], out: str) -> DataFrame:
    """Mean over columns of the tie-averaged rank divided by the number of rows."""
    n = df.agg(F.count(F.lit(1))).scalar()
    ranked = df
    for c in columns:
        ranks = average_rank(df, c, f"__r_{c}").drop("ties")
        renamed = ranks.withColumnRenamed(c, "__v")
        ranked = ranked.join(renamed, F.col(c).eqNullSafe(F.col("__v"))).drop("__v")
    mean = weighted_mean([F.col(f"__r_{c}") / n for c in columns])
    return ranked.select(key, mean.alias(out))


def file_weight(name: str) -> int:
    """Weight in a file name: ``_w3_`` is 3, otherwise 1."""
    found = re.search(r"_[wW](\d+)_", name)
    return int(found.group(1)) if found else 1


def majority_vote(tables: Mapping[str, DataFrame], key: str, label: str) -> DataFrame:
    """Label with most weighted votes per key, weight from the table's name; ties to the lowest label."""
    stacked = reduce(
        lambda a, b: a.unionByName(b),
        [df.select(key, label).withColumn("__w", F.lit(file_weight(n))) for n, df in tables.items()],
    )
    votes = stacked.groupBy(key, label).agg(F.sum("__w").alias("__w"))
    return votes.groupBy(key).agg(F.min_by(label, F.struct(-F.col("__w"), F.col(label))).alias(label))


def mean_by_id(tables: Sequence[DataFrame], key: str, value: str) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), [t.select(key, value) for t in tables]).groupBy(key).agg(F.avg(value).alias(value))


def best_weights(df: DataFrame, target: str, p1: str, p2: str, p3: str, steps: int = 100) -> DataFrame:
    """Weights (w1, w2, 1 - w1 - w2) on a grid with the lowest root mean squared error.

    The squared error is quadratic in the weights, so one pass over the rows
    gives the six moments from which every grid point follows.
    """
    d1, d2, e = F.col(p1) - F.col(p3), F.col(p2) - F.col(p3), F.col(target) - F.col(p3)
    m = df.agg(
        F.avg(d1 * d1).alias("a"), F.avg(d2 * d2).alias("b"), F.avg(d1 * d2).alias("c"),
        F.avg(d1 * e).alias("d"), F.avg(d2 * e).alias("f"), F.avg(e * e).alias("g"),
    )
    i, j = F.col("i"), F.col("j")
    w1, w2 = i / steps, j / steps
    grid = m.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(steps - 1)))).withColumn(
        "j", F.explode(F.sequence(F.lit(0), F.lit(steps - 1)))
    ).where(i + j < steps)
    mse = w1 * w1 * F.col("a") + w2 * w2 * F.col("b") + 2 * w1 * w2 * F.col("c") - 2 * w1 * F.col("d") - 2 * w2 * F.col("f") + F.col("g")
    scored = grid.select(w1.alias("w1"), w2.alias("w2"), F.round(F.sqrt(F.greatest(mse, F.lit(0.0))), 9).alias("rmse"))
    return scored.agg(F.min_by(F.struct("w1", "w2", "rmse"), F.struct("rmse", "w1", "w2")).alias("b")).select("b.*")


# Share of the first model by listing category, and for all others.
CATEGORY_WEIGHTS = {
    "Beauty": 0.60, "Electronics": 0.60, "Handmade": 0.60, "Home": 0.55, "Kids": 0.60, "Men": 0.65,
    "catemissing": 0.60, "Other": 0.50, "Sports   Outdoors": 0.50, "Vintage   Collectibles": 0.55, "Women": 0.60,
}
DEFAULT_WEIGHT = 0.60


def category_blend(category: Column, a: Column, b: Column, weights: Mapping[str, float] = CATEGORY_WEIGHTS) -> Column:
    table = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
    w = F.coalesce(table[category], F.lit(DEFAULT_WEIGHT))
    return a * w + b * (1 - w)
