"""Per-user order sequences: positions, gaps, consecutive baskets, transitions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.ranges import split_window


def order_history(orders: DataFrame) -> DataFrame:
    """Number each user's orders by time and add the days since the previous one.

    Input (order_id, user_id, order_time, ...). The last order of a user is
    ``test``, the one before ``train``, the rest ``prior``.
    """
    numbered = split_window(
        orders, ["user_id"], ["order_time", "order_id"], row_number="order_number", lags={"__previous": "order_time"}
    )
    totals = orders.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_orders"))
    left = F.col("n_orders") - F.col("order_number")
    return (
        numbered.withColumn("days_since_prior", F.datediff("order_time", "__previous").cast("long"))
        .drop("__previous")
        .join(totals, "user_id")
        .withColumn("eval_set", F.when(left == 0, "test").when(left == 1, "train").otherwise("prior"))
    )


def mark_reorders(lines: DataFrame) -> DataFrame:
    """1 when the user bought the product in an earlier order."""
    # a task holds the orders of one user with one product; one shuffle carries the lines
    first = F.min("order_number").over(Window.partitionBy("user_id", "product_id"))
    known = lines.where(F.col("user_id").isNotNull() & F.col("product_id").isNotNull())
    return known.withColumn("reordered", (F.col("order_number") > first).cast("long"))


def last_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str], n: int) -> DataFrame:
    """The last ``n`` rows per key; each task passes on at most ``n`` rows of a key."""
    back = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    return df.withColumn("__r", F.row_number().over(back)).where(F.col("__r") <= n).drop("__r")


def nth_from_last(df: DataFrame, keys: Sequence[str], order: Sequence[str], n: int) -> DataFrame:
    back = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    return df.withColumn("__r", F.row_number().over(back)).where(F.col("__r") <= n).where(
        F.col("__r") == n
    ).drop("__r")


def rows_between(df: DataFrame, keys: Sequence[str], order: Sequence[str], low: int, high: int) -> DataFrame:
    """Rows ``low`` to ``high`` (1-based) per key."""
    forward = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__r", F.row_number().over(forward)).where(F.col("__r") <= high).where(
        F.col("__r") >= low
    ).drop("__r")


def consecutive_baskets(lines: DataFrame) -> DataFrame:
    """Products kept, added and dropped between each order and the user's previous one.

    One row per (user, order_number > 1, product) with ``before`` and ``now``
    flags. Held in long form, so a basket of any size stays spread out.
    """
    now = lines.select("user_id", "order_number", "product_id").withColumn("now", F.lit(1))
    before = lines.join(
        lines.groupBy("user_id").agg(F.max("order_number").alias("__end")), "user_id"
    ).where("order_number < __end").select(
        "user_id", (F.col("order_number") + 1).alias("order_number"), "product_id", F.lit(1).alias("before")
    )
    return (
        now.where("order_number > 1")
        .join(before, ["user_id", "order_number", "product_id"], "full")
        .select(
            "user_id", "order_number", "product_id",
            F.coalesce("before", F.lit(0)).alias("before"), F.coalesce("now", F.lit(0)).alias("now"),
        )
    )


def transition_table(lines: DataFrame, orders: DataFrame, as_written: bool = False) -> DataFrame:
    """Probabilities of a product's in/out states between consecutive orders.

    Counts get +1 and totals +2. ``as_written`` takes N as the sum over order
    rows of (orders of the user - 1) instead of the number of transitions.
    """
    flags = consecutive_baskets(lines)
    counts = flags.groupBy("product_id").agg(
        F.sum("before").alias("n1"),
        F.sum(F.col("before") * F.col("now")).alias("n11"),
        F.sum(F.col("before") * (1 - F.col("now"))).alias("n10"),
        F.sum((1 - F.col("before")) * F.col("now")).alias("n01"),
    )
    if as_written:
        per_user = orders.groupBy("user_id").agg(F.count(F.lit(1)).alias("k"))
        n = per_user.agg(F.sum(F.col("k") * (F.col("k") - 1))).scalar()
    else:
        n = orders.where("order_number > 1").agg(F.count(F.lit(1))).scalar()
    n0 = n - F.col("n1")
    out = {
        "P0": (n0 + 1) / (n + 2),
        "P00": (n0 - F.col("n01") + 1) / (n0 + 2),
        "P01": (F.col("n01") + 1) / (n0 + 2),
        "P1": (F.col("n1") + 1) / (n + 2),
        "P10": (F.col("n10") + 1) / (F.col("n1") + 2),
        "P11": (F.col("n11") + 1) / (F.col("n1") + 2),
    }
    return counts.select("product_id", *[e.alias(k) for k, e in out.items()])


def state_rows(table: DataFrame) -> DataFrame:
    """One row per (product, reordered state) with that state's three probabilities."""
    names = ("P0", "P1", "P2")
    zero = table.select("product_id", F.lit(0).cast("long").alias("reordered"),
                        *[F.col(c).alias(n) for c, n in zip(("P0", "P00", "P01"), names)])
    one = table.select("product_id", F.lit(1).cast("long").alias("reordered"),
                       *[F.col(c).alias(n) for c, n in zip(("P1", "P10", "P11"), names)])
    return zero.unionByName(one)


def months_between(a: Column, b: Column) -> Column:
    """Calendar months from ``b`` to ``a``, days ignored."""
    return 12 * (F.year(a) - F.year(b)) + F.month(a) - F.month(b)
