"""Progressive validation: every block of time is scored by a model of the blocks before it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def progressive_bayes(rows: DataFrame, key: str, block: str, label: str, fields: Sequence[str], *,
                      smooth: float = 1.0, levels: float = 2.0) -> DataFrame:
    """(key, block, label, p): naive Bayes over ``fields``, fitted on earlier blocks only.

    The state of a model is a table of counts per (field, value), which add up over
    blocks; running sums over the blocks before give every block its own model without
    fitting one per block. A value seen c times among N rows of a class has the chance
    (c + smooth) / (N + smooth * levels). Null values are a value. Running sums go over the
    blocks in which a value occurs, never over rows.
    """
    long = rows.select(key, block, label, F.explode(F.array(*[
        F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields
    ])).alias("__x")).select(key, block, label, "__x.field", F.coalesce("__x.value", F.lit("\0")).alias("value"))
    seen = long.groupBy("field", "value", block).agg(F.sum(label).alias("__pos"), F.count(F.lit(1)).alias("__n"))
    earlier = Window.partitionBy("field", "value").orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    state = seen.select(
        "field", "value", block,
        F.coalesce(F.sum("__pos").over(earlier), F.lit(0)).alias("__vp"),
        F.coalesce(F.sum(F.col("__n") - F.col("__pos")).over(earlier), F.lit(0)).alias("__vn"),
    )
    blocks = rows.groupBy(block).agg(F.sum(label).alias("__pos"), F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy(block).rowsBetween(Window.unboundedPreceding, -1)  # one row per block
    totals = blocks.select(
        block, F.coalesce(F.sum("__pos").over(before), F.lit(0)).alias("__p"),
        F.coalesce(F.sum(F.col("__n") - F.col("__pos")).over(before), F.lit(0)).alias("__q"),
    )
    share = lambda c, n: (F.col(c) + smooth) / (F.col(n) + smooth * levels)
    evidence = F.sum(F.log(share("__vp", "__p") / share("__vn", "__q")))
    prior = F.log((F.col("__p") + smooth) / (F.col("__q") + smooth))
    return (
        long.join(state, ["field", "value", block]).join(totals, block)
        .groupBy(key, block, label, "__p", "__q").agg(evidence.alias("__e"))
        .select(key, block, label, (1 / (1 + F.exp(-(prior + F.col("__e"))))).alias("p"))
    )
