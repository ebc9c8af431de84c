"""Baskets that maximise the expected F1 score of an order."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, StructField, StructType


def _laws(p: np.ndarray) -> list[np.ndarray]:
    """Distribution of the number of successes among the first 0, 1, ... trials."""
    laws = [np.ones(1)]
    for q in p:
        laws.append(np.convolve(laws[-1], [1 - q, q]))
    return laws


def expected_score(hits: np.ndarray, others: np.ndarray, none: bool) -> float:
    """Expected F1 of a basket from the laws of its hits and of the purchases outside it.

    With h hits among k items and r other purchases the score is
    2h / (k + h + r). ``none`` adds the entry None to the basket, which is
    right if nothing is bought.
    """
    h, r = np.arange(len(hits))[:, None], np.arange(len(others))[None, :]
    chosen = len(hits) - 1 + none
    f1 = 2 * h / np.maximum(chosen + h + r, 1)
    if none:
        f1[0, 0] = 2 / (chosen + 1)
    return float(hits @ f1 @ others)


def best_size(p: np.ndarray) -> tuple[int, bool, float]:
    """How many of the items sorted by falling probability to choose, and whether to add None.

    Items are bought independently. Every prefix is scored with and without
    None; of equal scores the one with None and the shorter prefix is taken.
    """
    hits, others = _laws(p), _laws(p[::-1])[::-1]
    scores = [(expected_score(hits[k], others[k], none), none, -k) for k in range(len(p) + 1) for none in (True, False)]
    score, none, k = max(scores)
    return -k, none, score


_SIZE = StructType([StructField("size", IntegerType()), StructField("none", BooleanType())])


def _sizes(probabilities: pd.Series) -> pd.DataFrame:
    best = [best_size(np.asarray(p, dtype=float))[:2] for p in probabilities]
    return pd.DataFrame(best, columns=["size", "none"])


def best_baskets(predictions: DataFrame, floor: float = 0.05) -> DataFrame:
    """Chosen products per order as text, from (order_id, product_id, prediction).

    An order's list holds at most one entry per product of the catalogue, and
    only products above ``floor``; whole Arrow batches of orders reach Python.
    """
    candidates = predictions.where(F.col("prediction") > floor).groupBy("order_id", "product_id").agg(
        F.max("prediction").alias("prediction")
    )
    ordered = F.sort_array(F.collect_list(F.struct((-F.col("prediction")).alias("n"), "product_id")))
    lists = candidates.groupBy("order_id").agg(ordered.alias("items"))
    sizes = F.pandas_udf(_sizes, _SIZE)
    sized = lists.withColumn("best", sizes(F.transform("items", lambda x: -x["n"])))
    chosen = F.transform(F.slice("items", F.lit(1), F.col("best.size")), lambda x: x["product_id"].cast("string"))
    none = F.when(F.col("best.none"), F.array(F.lit("None"))).otherwise(F.array().cast("array<string>"))
    return sized.select("order_id", F.array_join(F.concat(none, chosen), " ").alias("products"))
