"""Regression on bags of instances. Rows are (bag, instance, features..., y) with y per bag."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.ml.clustering import KMeans
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.models import assembled
from tessera.operators.sampling import equal_bags
from tessera.session import cut_lineage


def exemplars(df: DataFrame, columns: Sequence[str], k: int, seed: int = 7) -> tuple[DataFrame, int]:
    """(bag, y, cluster, features): a bag's mean in each cluster, its overall mean where it has no instance."""
    vectors = assembled(df, columns)
    clustered = KMeans(k=k, seed=seed, predictionCol="cluster").fit(vectors).transform(vectors)
    overall = df.groupBy("bag").agg(F.first("y").alias("y"), *[F.avg(c).alias(f"__{c}") for c in columns])
    inside = clustered.groupBy("bag", "cluster").agg(*[F.avg(c).alias(c) for c in columns])
    every = overall.withColumn("cluster", F.explode(F.array(*[F.lit(i) for i in range(k)])))
    filled = every.join(inside, ["bag", "cluster"], "left").select(
        "bag", "y", "cluster", *[F.coalesce(c, f"__{c}").alias(c) for c in columns]
    )
    return filled, k


def cluster_regression(df: DataFrame, columns: Sequence[str], k: int = 3) -> DataFrame:
    """One regression per cluster of exemplars; predictions of the one with the least squared error."""
    sets, k = exemplars(df, columns, k)
    sets = cut_lineage(assembled(sets, columns))
    best = None
    for i in range(k):
        part = sets.where(F.col("cluster") == i)
        model = LinearRegression(labelCol="y").fit(part)
        predicted = model.transform(part).select("bag", "cluster", "y", "prediction")
        mse = predicted.agg(F.avg(F.pow(F.col("prediction") - F.col("y"), F.lit(2.0)))).first()[0]
        if best is None or mse < best[0]:
            best = (mse, predicted)
    return best[1]


def pruned_regression(df: DataFrame, columns: Sequence[str], size: int, rate: float = 0.05) -> DataFrame:
    """Drop, round by round, the instances whose prediction is farthest from the bag's median.

    Bags are first made equal in size; a round keeps (1 - rate) of each and the
    loop ends when the squared error of the bag medians stops falling. Returns
    (bag, y, prediction) of the last model that improved.
    """
    def fitted(rows):
        scored = LinearRegression(labelCol="y").fit(rows).transform(rows)
        # every bag has the same small size, so its median is a small aggregate
        medians = scored.groupBy("bag").agg(F.median("prediction").alias("middle"), F.first("y").alias("y"))
        mse = medians.agg(F.avg(F.pow(F.col("middle") - F.col("y"), F.lit(2.0)))).first()[0]
        return scored, medians, mse

    rows = cut_lineage(assembled(equal_bags(df, "bag", "instance", size), columns))
    scored, medians, mse = fitted(rows)
    keep = size
    while (keep := int((1 - rate) * keep)) >= 1:
        nearest = Window.partitionBy("bag").orderBy("__gap", "slot")
        kept = scored.join(medians.select("bag", "middle"), "bag").withColumn(
            "__gap", F.pow(F.col("prediction") - F.col("middle"), F.lit(2.0))
        ).withColumn("__r", F.row_number().over(nearest)).where(F.col("__r") <= keep)
        rows = cut_lineage(kept.drop("__gap", "__r", "middle", "prediction"))
        new_scored, new_medians, new_mse = fitted(rows)
        if new_mse >= mse:
            break
        scored, medians, mse = new_scored, new_medians, new_mse
    return medians.select("bag", "y", F.col("middle").alias("prediction"))


def _dot(columns: Sequence[Column], weights: Sequence[float]) -> Column:
    return reduce(lambda a, b: a + b, [c * float(w) for c, w in zip(columns, weights)])


def weighted_bags(df: DataFrame, x: Sequence[Column], o: Sequence[float], w: Sequence[float]) -> DataFrame:
    """Per bag: prediction w.x under softmax weights of o.x, and the gradient parts.

    ``top`` keeps the exponentials within range; sums are combined before the shuffle.
    """
    rows = df.select("bag", "y", _dot(x, o).alias("s"), _dot(x, w).alias("g"), *[c.alias(f"x{j}") for j, c in enumerate(x)])
    top = rows.groupBy("bag").agg(F.max("s").alias("top"))
    e = F.exp(F.col("s") - F.col("top"))
    sums = rows.join(top, "bag").groupBy("bag").agg(
        F.first("y").alias("y"), F.sum(e).alias("z"), F.sum(e * F.col("g")).alias("eg"),
        *[F.sum(e * F.col(f"x{j}")).alias(f"ex{j}") for j in range(len(x))],
        *[F.sum(e * F.col("g") * F.col(f"x{j}")).alias(f"egx{j}") for j in range(len(x))],
    )
    return sums.withColumn("prediction", F.col("eg") / F.col("z"))


def instance_weighted_regression(df: DataFrame, columns: Sequence[str], epochs: int = 10, rate: float = 0.5) -> DataFrame:
    """Learn the instance weights and the regression together by full-batch steps.

    Each epoch is two grouped passes and a one-row sum; only the gradient, two
    numbers per feature, reaches the driver. Returns (bag, y, prediction).
    """
    df = cut_lineage(df)
    x = [F.lit(1.0), *[F.col(c) for c in columns]]
    d = len(x)
    o, w = [0.0] * d, [0.0] * d
    past_o, past_w = [1e-12] * d, [1e-12] * d
    for _ in range(epochs):
        bags = weighted_bags(df, x, o, w)
        err = F.col("prediction") - F.col("y")
        z = F.col("z")
        grad = bags.agg(
            *[F.avg(err * F.col(f"ex{j}") / z).alias(f"w{j}") for j in range(d)],
            *[F.avg(err * (F.col(f"egx{j}") / z - F.col("prediction") * F.col(f"ex{j}") / z)).alias(f"o{j}") for j in range(d)],
        ).first()
        # steps shrink with the squares of the gradients seen so far
        for j in range(d):
            past_w[j] += grad[f"w{j}"] ** 2
            past_o[j] += grad[f"o{j}"] ** 2
            w[j] -= rate * grad[f"w{j}"] / past_w[j] ** 0.5
            o[j] -= rate * grad[f"o{j}"] / past_o[j] ** 0.5
    return weighted_bags(df, x, o, w).select("bag", "y", "prediction")
