"""Views of the test tables shared by several query modules."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.catalog.views import basket_lines, basket_orders

FLAGS = ["click", "error", "purchase", "signup", "view"]

PANEL = """pn AS (SELECT user_id, CAST(date_diff('day', TIMESTAMP '2024-01-01', ts) // 7 AS BIGINT) AS w,
  CAST(max(event_type = 'click') AS INT) AS click, CAST(max(event_type = 'error') AS INT) AS error,
  CAST(max(event_type = 'purchase') AS INT) AS purchase, CAST(max(event_type = 'signup') AS INT) AS signup,
  CAST(max(event_type = 'view') AS INT) AS view FROM events GROUP BY ALL)"""


def weekly_panel(t) -> DataFrame:
    """One row per (user, week) with a 0/1 flag for each event type seen."""
    week = F.floor(F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")) / 7).cast("long")
    return t.events.groupBy("user_id", week.alias("w")).agg(
        *[F.max((F.col("event_type") == f).cast("int")).alias(f) for f in FLAGS]
    )


def basket_links(t) -> tuple[DataFrame, DataFrame]:
    """Baskets as (id, item) and links from each order to the user's next three."""
    orders = basket_orders(t)
    sets = basket_lines(t, orders).select(F.col("order_id").alias("id"), F.col("product_id").alias("item"))
    ahead = orders.select("user_id", F.col("order_id").alias("id"),
                          F.explode(F.array(*[F.col("order_number") + k for k in (1, 2, 3)])).alias("order_number"))
    then = orders.select("user_id", "order_number", F.col("order_id").alias("id2"), F.col("order_dow").alias("class"))
    return sets, ahead.join(then, ["user_id", "order_number"]).select("id", "id2", "class")


def part_pairs(t) -> DataFrame:
    """Parts on consecutive lines of an order: pairs (a, b)."""
    one = t.lineitem.select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("a"))
    two = t.lineitem.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("l_partkey").alias("b"))
    return one.join(two, ["l_orderkey", "l_linenumber"]).where("a <> b").select("a", "b").distinct()
