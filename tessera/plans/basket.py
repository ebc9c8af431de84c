"""Reorder features: product, user, user x group, user x product, and their joins.

Every function takes order lines (one row per order and product) and, where
needed, orders as made by ``order_history``. Most read them several times, so
pass written tables rather than long plans. Ratios with a zero base are null.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.aggregates import (
    mode_per_key, parent_share, purchase_counts, reorder_stats, repeat_buyers, second_highest,
)
from tessera.operators.joins import lines_of, looked_up, star_join
from tessera.operators.ranges import split_window
from tessera.operators.sequences import (
    last_rows, rows_between, state_rows, transition_table,
)
from tessera.session import ALL_JOIN_KEYS, cut_by_user, cut_lineage

UP = ["user_id", "product_id"]


def product_features(lines: DataFrame, prefix: str = "prod_") -> DataFrame:
    """Per product: reorder statistics, users who reordered, mean cart place."""
    per_user = purchase_counts(lines).groupBy("product_id").agg(
        F.count_if(F.col("again") > 0).alias(f"{prefix}users_reordered"),
        F.avg((F.col("again") > 0).cast("double")).alias(f"{prefix}reorder_prob"),
    )
    cart = lines.groupBy("product_id").agg(F.avg("cart_pos").alias(f"{prefix}cart_mean"))
    return reorder_stats(lines, prefix).join(per_user, "product_id").join(cart, "product_id")


def user_features(orders: DataFrame, lines: DataFrame, prefix: str = "user_") -> DataFrame:
    """Per user: order count, time span, gap statistics, basket sizes, habits."""
    gaps = orders.groupBy("user_id").agg(
        F.max("order_number").alias(f"{prefix}orders"),
        F.coalesce(F.sum("days_since_prior"), F.lit(0)).alias(f"{prefix}period"),
        F.avg("days_since_prior").alias(f"{prefix}mean_days_since_prior"),
        # a gap is a whole number of days, so the median keeps few distinct values
        F.median("days_since_prior").alias(f"{prefix}median_days_since_prior"),
        F.var_samp("days_since_prior").alias(f"{prefix}sd_days_since_prior"),
    )
    sizes = lines.groupBy("user_id", "order_id").agg(
        F.count(F.lit(1)).alias("size"), F.sum("reordered").alias("again"),
        F.max("order_number").alias("order_number"),
    )
    baskets = sizes.groupBy("user_id").agg(
        F.sum("size").alias(f"{prefix}total_products"),
        F.avg("size").alias(f"{prefix}mean_order_size"),
        F.try_divide(
            F.sum("again"), F.sum(F.when(F.col("order_number") > 1, F.col("size")).otherwise(0))
        ).alias(f"{prefix}reorder_ratio"),
    )
    distinct_products = lines.groupBy("user_id", "product_id", "department_id").agg(F.lit(1).alias("one"))
    kinds = distinct_products.groupBy("user_id").agg(
        F.count(F.lit(1)).alias(f"{prefix}distinct_products"),
        F.count_distinct("department_id").alias(f"{prefix}median_basket"),
    )
    hour = mode_per_key(orders, ["user_id"], "order_hour", f"{prefix}mode_hour")
    dow = mode_per_key(orders, ["user_id"], "order_dow", f"{prefix}mode_dow")
    out = gaps.join(baskets, "user_id").join(kinds, "user_id").join(hour, "user_id").join(dow, "user_id")
    return out.withColumn(
        f"{prefix}average_basket", F.col(f"{prefix}total_products") / F.col(f"{prefix}orders")
    )


def current_orders(orders: DataFrame, eval_set: str) -> DataFrame:
    """The order to predict for, one per user, with the days since the one before."""
    return orders.where(F.col("eval_set") == eval_set).select(
        "user_id", "order_id", "order_dow", "order_hour",
        F.col("days_since_prior").alias("time_since_last_order"),
    )


def user_group_features(lines: DataFrame, group: str, prefix: str) -> DataFrame:
    """Per user and aisle or department: lines, reorders, orders, mean cart place."""
    return lines.groupBy("user_id", group).agg(
        F.count(F.lit(1)).alias(f"{prefix}_product"),
        F.sum("reordered").alias(f"{prefix}_reorder"),
        F.count_distinct("order_id").alias(f"{prefix}_orders"),
        F.avg("cart_pos").alias(f"{prefix}_add_to_cart"),
        (F.sum("reordered") / F.count_distinct("order_id")).alias(f"{prefix}_reorder_ratio"),
    )


def user_time_features(lines: DataFrame, time: str, prefix: str, parts: int | None = None) -> DataFrame:
    """Per user and weekday or hour: counts, reorder ratio, modal department and aisle."""
    keys = ["user_id", time]
    first = [
        F.count(F.lit(1)).alias(f"{prefix}_product"),
        F.sum("reordered").alias(f"{prefix}_reorder"),
        F.count_distinct("order_id").alias(f"{prefix}_orders"),
    ]
    more = [
        F.count_distinct("department_id").alias(f"{prefix}_department"),
        F.count_distinct("aisle_id").alias(f"{prefix}_aisle"),
    ]
    if parts:
        # several distinct counts at once would move a row for each of them
        counts = star_join(lines.groupBy(*keys).agg(*first), [(lines.groupBy(*keys).agg(c), keys) for c in more])
    else:
        counts = lines.groupBy(*keys).agg(*first, *more)
    return (
        counts.withColumn(f"{prefix}_reorder_ratio", F.col(f"{prefix}_reorder") / F.col(f"{prefix}_orders"))
        .join(mode_per_key(lines, keys, "department_id", f"{prefix}_mode_department"), keys)
        .join(mode_per_key(lines, keys, "aisle_id", f"{prefix}_mode_aisle"), keys)
    )


def user_product_features(lines: DataFrame, users: DataFrame) -> DataFrame:
    """Per user and product: how often, when first and last, where in the cart."""
    # lines dealt by user bring the sizes along
    sized = lines.where("order_id is not null") if "order_size" in lines.columns else lines.join(
        lines.groupBy("order_id").agg(F.count(F.lit(1)).alias("order_size")), "order_id"
    )
    sized = sized.withColumn("inverted", F.col("order_size") - F.col("cart_pos")).withColumn(
        "relative", F.col("cart_pos") / F.col("order_size")
    )
    stats = sized.groupBy(*UP).agg(
        F.count(F.lit(1)).alias("up_orders"),
        F.min("order_number").alias("up_first_order"),
        F.max("order_number").alias("up_last_order"),
        F.avg("cart_pos").alias("up_mean_cart_position"),
        F.median("cart_pos").alias("up_median_cart_position"),
        F.avg("inverted").alias("up_inverted_mean"),
        F.median("inverted").alias("up_inverted_median"),
        F.avg("relative").alias("up_relative_mean"),
        F.avg("order_hour").alias("up_hour_mean"),
        F.avg("order_dow").alias("up_dow_mean"),
        F.avg("days_since_prior").alias("up_days_mean"),
        (F.sum("reordered") / F.count(F.lit(1))).alias("up_reorder_rate"),
        ((F.sum("reordered") + 1.0) / F.count(F.lit(1))).alias("up_reordered_ratio"),
    )
    out = stats.join(second_highest(lines, UP, "order_number", "up_se_last_order"), UP).join(
        users.select("user_id", "user_orders"), "user_id"
    )
    span = F.col("user_orders") + 1
    return out.select(
        "*",
        (F.col("up_orders") / F.col("user_orders")).alias("up_order_rate"),
        (F.col("user_orders") - F.col("up_last_order")).alias("up_orders_since_last_order"),
        (F.col("up_orders") / (span - F.col("up_first_order"))).alias("up_order_rate_since_first_order"),
        (F.col("up_last_order") - F.col("up_se_last_order")).alias("up_orders_since_se_last_order"),
        (F.col("up_orders") / (span - F.col("up_se_last_order"))).alias("up_order_rate_since_se_first_order"),
    ).drop("user_orders")


def window_blocks(
    orders: DataFrame, lines: DataFrame, prefix: str, parts: int | None = None
) -> list[tuple[DataFrame, list[str]]]:
    """Product, user and user x product features over ``orders``, with the keys of each table."""
    base = lines_of(lines, orders, parts)
    users = user_features(orders, base, f"{prefix}user_")
    pairs = user_product_features(base, users.select("user_id", F.col(f"{prefix}user_orders").alias("user_orders")))
    named = pairs.select(*UP, *[F.col(c).alias(f"{prefix}{c}") for c in pairs.columns if c not in UP])
    return [(reorder_stats(base, f"{prefix}prod_"), ["product_id"]), (users, ["user_id"]), (named, UP)]


def window_features(orders: DataFrame, lines: DataFrame, prefix: str) -> DataFrame:
    """The blocks of a subset of each user's orders, per line of it."""
    base = lines.join(orders.select("order_id"), "order_id", "left_semi")
    return star_join(base.select("order_id", "user_id", "product_id"), window_blocks(orders, lines, prefix))


def recent_orders(orders: DataFrame, n: int = 3) -> DataFrame:
    return last_rows(orders, ["user_id"], ["order_number"], n)


def early_orders(orders: DataFrame, low: int = 2, high: int = 4) -> DataFrame:
    return rows_between(orders, ["user_id"], ["order_number"], low, high)


def recent_features(orders: DataFrame, lines: DataFrame, n: int = 3) -> DataFrame:
    return window_features(recent_orders(orders, n), lines, "r_")


def early_features(orders: DataFrame, lines: DataFrame, low: int = 2, high: int = 4) -> DataFrame:
    return window_features(early_orders(orders, low, high), lines, "e_")


def repeat_buyer_features(lines: DataFrame, parts: int | None = None) -> DataFrame:
    """Per user and product: repeat shares, share in aisle and department, repeat gaps."""
    again = lines.where("reordered = 1")
    shares = []
    for group, short in (("department_id", "d"), ("aisle_id", "a")):
        s = parent_share(again, group, "product_id")
        shares.append(s.select(
            group, "product_id", F.col("n_ratio").alias(f"n_{short}p_ratio"),
            F.col("users_ratio").alias(f"u_{short}p_ratio"),
        ))
    gaps = lines.groupBy(*UP).agg(
        F.avg("days_since_prior").alias("repeat_buy_day"),
        F.avg(F.when(F.col("reordered") == 1, F.col("days_since_prior"))).alias("repeat_buy_day_o"),
    )
    product_gap = again.groupBy("product_id").agg(F.avg("days_since_prior").alias("repeat_buy_day_p"))
    up = looked_up(gaps, product_gap, ["product_id"], parts=parts).withColumn(
        "repeat_buy_day_ratio", F.try_divide("repeat_buy_day_o", "repeat_buy_day_p")
    ).fillna(0.0)
    repeats = {}
    for key, short in (("department_id", "d"), ("product_id", "p")):
        repeats[short] = repeat_buyers(lines, key).select(
            key, F.col("repeat_users").alias(f"repeat_{short}"), F.col("repeat_ratio").alias(f"repeat_{short}_ratio")
        )
    base = lines.select(*UP, "aisle_id", "department_id").distinct()
    for table, keys in (
        (repeats["d"], ["department_id"]), (repeats["p"], ["product_id"]),
        (shares[1], ["aisle_id", "product_id"]), (shares[0], ["department_id", "product_id"]),
    ):
        base = looked_up(base, table, keys, parts=parts)
    return base.join(up, UP, "left")


def pattern_features(lines: DataFrame, parts: int | None = None) -> DataFrame:
    """Per reordered line: days between repeats, early and late means, scaled order numbers."""
    again = lines.where("reordered = 1").select(*UP, "order_id", "order_number", "order_time", "days_since_prior")
    running = split_window(
        again, UP, ["order_number", "order_id"], row_number="place",
        # lines dealt by user are windowed where they lie
        bucket=None if parts else F.floor(F.col("order_number") / 64), sums={"cumsum_order_day": "days_since_prior"},
    )
    # the step between running sums is the row's own gap, 0 on the first row
    steps = running.withColumn(
        "diff_order_day", F.when(F.col("place") == 1, 0).otherwise(F.col("days_since_prior"))
    )
    steps = cut_by_user(steps, parts) if parts else cut_lineage(steps)
    stats = steps.groupBy(*UP).agg(
        F.avg("order_number").alias("__mean"), F.max("order_number").alias("__max"),
        F.count(F.lit(1)).alias("__n"), F.avg("diff_order_day").alias("mean_diff_order_day"),
    ).withColumn("__skew", F.col("__mean") / F.col("__max"))
    ends = steps.join(stats.select(*UP, "__n"), UP).groupBy(*UP).agg(
        F.avg(F.when(F.col("place").between(2, 4), F.col("diff_order_day"))).alias("e_mean_diff_order_day"),
        F.avg(F.when(F.col("place") >= F.col("__n") - 1, F.col("diff_order_day"))).alias("r_mean_diff_order_day"),
    )

    def scaled(c):
        low, high = stats.agg(F.min(c)).scalar(), stats.agg(F.max(c)).scalar()
        return F.try_divide(F.col(c) - low, high - low)

    scaled_stats = stats.select(
        *UP, "mean_diff_order_day", scaled("__mean").alias("order_number_mean"),
        scaled("__skew").alias("order_number_skew"),
    )
    return steps.select(*UP, "order_id", "cumsum_order_day", "diff_order_day").join(
        scaled_stats, UP
    ).join(ends, UP).fillna(0.0)


def markov_features(
    orders: DataFrame, lines: DataFrame, as_written: bool = False, parts: int | None = None
) -> DataFrame:
    """Products of each user's latest order with the probabilities of their state."""
    table = transition_table(lines, orders, as_written)
    if parts:
        # both states read it
        table = cut_lineage(table)
    latest = last_rows(orders, ["user_id"], ["order_number"], 1).select("order_id")
    now = lines_of(lines, latest, parts).select("order_id", "user_id", "product_id", "reordered")
    return looked_up(now, state_rows(table), ["product_id", "reordered"], parts=parts).withColumnRenamed(
        "reordered", "pre_reorder"
    )


def candidate_rows(
    orders: DataFrame, lines: DataFrame, current: str = "train", vectors: DataFrame | None = None,
    parts: int | None = None,
) -> DataFrame:
    """One row per (order to predict, product the user bought before) with features and label.

    Aisle and department of a product come from the lines. ``vectors`` is an
    optional table of item embeddings (product_id and its columns). ``parts``
    tells that both tables were written by ``cut_by_user`` into that many files,
    and the lines with their ``order_size``: then users' rows are never moved,
    which needs ``ALL_JOIN_KEYS`` off until the result has been written.
    """
    def written(table: DataFrame) -> DataFrame:
        # a task sorts only a few tables at a time
        return cut_by_user(table, parts) if parts else table

    if parts:
        lines.sparkSession.conf.set(ALL_JOIN_KEYS, "false")
    prior_orders = orders.where("eval_set = 'prior'")
    prior = lines.where("eval_set = 'prior'")
    users = user_features(prior_orders, prior)
    users = cut_by_user(users, parts) if parts else cut_lineage(users)
    label = lines.where(F.col("eval_set") == current).select(*UP, F.lit(1).cast("long").alias("label"))
    shelves = prior.groupBy("product_id").agg(F.min("aisle_id").alias("aisle_id"), F.min("department_id").alias("department_id"))
    base = written(user_product_features(prior, users))
    now = current_orders(orders, current)
    pattern = pattern_features(prior, parts).groupBy(*UP).agg(
        F.max("mean_diff_order_day").alias("mean_diff_order_day"), F.max("order_number_mean").alias("order_number_mean")
    )
    blocks = [
        (product_features(prior), ["product_id"]),
        (users, ["user_id"]),
        (user_group_features(prior, "aisle_id", "ua"), ["user_id", "aisle_id"]),
        (user_group_features(prior, "department_id", "ud"), ["user_id", "department_id"]),
        (user_time_features(prior, "order_dow", "ut", parts), ["user_id", "order_dow"]),
        (user_time_features(prior, "order_hour", "uh", parts), ["user_id", "order_hour"]),
        *window_blocks(recent_orders(prior_orders), prior, "r_", parts),
        *window_blocks(early_orders(prior_orders), prior, "e_", parts),
        (repeat_buyer_features(prior, parts).drop("aisle_id", "department_id"), UP),
        *([(vectors, ["product_id"])] if vectors is not None else []),
        (pattern, UP),
        (markov_features(prior_orders, prior, parts=parts).drop("order_id", "pre_reorder"), UP),
        (label, UP),
    ]
    blocks = [(table if table is users or table is label or "user_id" not in keys else written(table), keys) for table, keys in blocks]
    # the keys meet products and users first, while rows are short; tables of many columns per row come last
    out = looked_up(prior.select(*UP).distinct(), shelves, ["product_id"], "inner", parts).join(now, "user_id")
    for table, keys in blocks:
        if "user_id" not in keys:
            out = looked_up(out, table, keys, parts=parts)
    sides = [b for b in blocks if "user_id" in b[1] and b[1] != UP]
    for some in (sides[:3], sides[3:]):
        out = written(star_join(out, some))
    out = star_join(out.join(base, UP), [b for b in blocks if b[1] == UP])
    named = [*base.columns, "aisle_id", "department_id", *[c for c in now.columns if c != "user_id"]]
    named += [c for table, keys in blocks for c in table.columns if c not in keys]
    return out.select(*named).withColumn("label", F.coalesce("label", F.lit(0)).cast("long"))
