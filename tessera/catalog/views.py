"""The test tables seen as order lines, panels, clicks, text pairs and claims."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.sequences import mark_reorders, order_history


def basket_orders(t, parts: int | None = None) -> DataFrame:
    """One row per order; user = customer, hour = order key modulo 24. ``parts``: dealt by user."""
    source = t.orders.repartition(parts, "o_custkey") if parts else t.orders
    return order_history(
        source.select(
            F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("user_id"),
            F.col("o_orderdate").alias("order_time"),
            (F.dayofweek("o_orderdate") - 1).cast("long").alias("order_dow"),
            (F.col("o_orderkey") % 24).alias("order_hour"),
        )
    )


def products(t) -> DataFrame:
    """One row per product: the brand number, with an aisle and a department."""
    return (
        t.part.select(F.substring("p_brand", 7, 9).cast("long").alias("product_id"),
                      F.col("p_brand").alias("product_name"))
        .distinct()
        .withColumn("aisle_id", F.col("product_id") % 7)
        .withColumn("department_id", F.col("product_id") % 3)
    )


def basket_lines(t, orders: DataFrame | None = None, parts: int | None = None) -> DataFrame:
    """One row per (order, product) with its place in the cart and the reorder flag.

    With ``parts`` dealt by user, and with the number of prior lines of the order, counted where they lie together.
    """
    orders = basket_orders(t) if orders is None else orders
    brand = t.part.select("p_partkey", F.substring("p_brand", 7, 9).cast("long").alias("product_id"))
    items = (
        t.lineitem.select("l_orderkey", "l_partkey", "l_linenumber")
        .join(brand, F.col("l_partkey") == F.col("p_partkey"))
        # an order's lines lie together for the count of its products and for its join
        .where("l_orderkey is not null").repartition("l_orderkey")
        .groupBy(F.col("l_orderkey").alias("order_id"), "product_id")
        .agg(F.min("l_linenumber").cast("long").alias("cart_pos"))
        .withColumn("aisle_id", F.col("product_id") % 7)
        .withColumn("department_id", F.col("product_id") % 3)
    )
    lines = items.join(orders, "order_id")
    if parts:
        size = F.count_if(F.col("eval_set") == "prior").over(Window.partitionBy("order_id"))
        known = lines.where("user_id is not null and product_id is not null")
        lines = known.withColumn("order_size", size).repartition(parts, "user_id")
    return mark_reorders(lines)


BASKET = """
ord0 AS (SELECT o_orderkey AS order_id, o_custkey AS user_id, o_orderdate AS order_time,
  CAST(dayofweek(o_orderdate) AS BIGINT) AS order_dow, o_orderkey % 24 AS order_hour,
  row_number() OVER w AS order_number,
  date_diff('day', lag(o_orderdate) OVER w, o_orderdate) AS days_since_prior,
  count(*) OVER (PARTITION BY o_custkey) AS n_orders
  FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)),
ord AS (SELECT *, CASE WHEN n_orders = order_number THEN 'test' WHEN n_orders - order_number = 1 THEN 'train'
  ELSE 'prior' END AS eval_set FROM ord0),
prods AS (SELECT DISTINCT CAST(substr(p_brand, 7) AS BIGINT) AS product_id, p_brand AS product_name,
  CAST(substr(p_brand, 7) AS BIGINT) % 7 AS aisle_id, CAST(substr(p_brand, 7) AS BIGINT) % 3 AS department_id FROM part),
items AS (SELECT l_orderkey AS order_id, CAST(substr(p_brand, 7) AS BIGINT) AS product_id,
  CAST(min(l_linenumber) AS BIGINT) AS cart_pos
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL),
lines AS (SELECT i.order_id, i.product_id, cart_pos, i.product_id % 7 AS aisle_id, i.product_id % 3 AS department_id,
  o.user_id, order_time, order_dow, order_hour, order_number, days_since_prior, n_orders, eval_set,
  CAST(order_number > min(order_number) OVER (PARTITION BY user_id, product_id) AS BIGINT) AS reordered
  FROM items i JOIN ord o ON i.order_id = o.order_id),
prior AS (SELECT * FROM lines WHERE eval_set = 'prior')
"""


def basket_sql(body: str, extra: str = "") -> str:
    return f"WITH {BASKET}{', ' + extra if extra else ''} {body}"
