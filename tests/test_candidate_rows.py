"""Candidate rows of tables dealt by user: the same rows as of plain tables, and no user's rows moved."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators.frames import rounded
from tessera.operators.joins import lines_of
from tessera.operators.sequences import mark_reorders, order_history
from tessera.plans import basket as B
from tessera.session import ALL_JOIN_KEYS, cut_by_user, cut_lineage


def tables(spark):
    draw = random.Random(5)
    # order 3 is listed for two users
    orders = [(i, i % 9) for i in range(80)] + [(3, 1)]
    lines = [(o, p, n + 1) for o in range(80) for n, p in enumerate(draw.sample(range(1, 8), draw.randint(1, 4)))]
    orders = order_history(
        spark.createDataFrame([(o, u, o % 7, o % 5) for o, u in orders], "order_id long, user_id long, order_dow long, order_hour long")
        .withColumn("order_time", F.date_add(F.lit("2020-01-01").cast("date"), (F.col("order_id") * 3).cast("int")))
    )
    items = spark.createDataFrame(lines, "order_id long, product_id long, cart_pos long").select(
        "*", (F.col("product_id") % 3).alias("aisle_id"), (F.col("product_id") % 2).alias("department_id")
    )
    return cut_lineage(orders), mark_reorders(items.join(orders, "order_id"))


def test_rows_dealt_by_user(spark):
    orders, lines = tables(spark)
    lines = cut_lineage(lines)
    size = F.count_if(F.col("eval_set") == "prior").over(Window.partitionBy("order_id"))
    dealt = (
        cut_by_user(orders.repartition(3, "user_id"), 3),
        cut_by_user(lines.withColumn("order_size", size).repartition(3, "user_id"), 3),
    )
    some = dealt[0].where("order_number < 3")
    columns = ["user_id", "order_id", "product_id"]
    assert sorted(lines_of(dealt[1], some, 3).select(*columns).collect()) == sorted(lines_of(lines, some).select(*columns).collect())
    plain = B.candidate_rows(orders, lines)
    want = sorted(map(str, rounded(plain).collect()))
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", ALL_JOIN_KEYS)}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = B.candidate_rows(*dealt, parts=3)
        assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
        assert found.columns == plain.columns and sorted(map(str, rounded(found).collect())) == want
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
