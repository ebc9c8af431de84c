"""Projections, reshaping and joins."""

from pyspark.sql import functions as F

from tessera.catalog.base import query
from tessera.catalog.views import basket_lines, basket_orders, basket_sql, products
from tessera.operators import frames as R
from tessera.operators import joins as J
from tessera.operators.ranges import split_window
from tessera.session import cut_lineage, shuffles_for


@query("p01_select_drop_rename", "SELECT o_orderkey AS order_id, o_custkey AS user_id, o_totalprice FROM orders")
def _(t):
    return (t.orders.drop("o_orderpriority", "o_orderdate", "o_orderstatus")
            .withColumnRenamed("o_orderkey", "order_id").withColumnRenamed("o_custkey", "user_id"))


@query("p02_columns_by_name_part", "SELECT l_orderkey, l_partkey, l_suppkey FROM lineitem")
def _(t):
    return t.lineitem.select(R.columns_like(t.lineitem, prefix="l_", suffix="key"))


@query("p03_affix_columns", "SELECT c_custkey, c_name AS x_c_name_1, c_nationkey AS x_c_nationkey_1, c_acctbal AS x_c_acctbal_1, c_mktsegment AS x_c_mktsegment_1 FROM customer")
def _(t):
    return R.with_affix(t.customer, "x_", "_1", keep=["c_custkey"])


@query("p04_filter_range", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity >= 10 AND l_quantity < 30 AND l_returnflag = 'R' AND l_linestatus <> 'O'")
def _(t):
    return t.lineitem.where("l_quantity >= 10 AND l_quantity < 30 AND l_returnflag = 'R' AND l_linestatus <> 'O'").select(
        "l_orderkey", "l_linenumber", "l_quantity")


@query("p05_membership", """SELECT o_orderkey, o_custkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')
  AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')
  AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')""")
def _(t):
    building = t.customer.where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    returned = t.lineitem.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return (t.orders.where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).select("o_orderkey", "o_custkey")
            .join(building, "o_custkey", "left_semi").join(returned, "o_orderkey", "left_anti"))


@query("p06_null_row_update", """SELECT l_orderkey, l_linenumber, l_partkey, round(coalesce(nullif(l_tax, 0), m), 6) AS tax, nullif(l_tax, 0) IS NULL AS was_null
  FROM lineitem LEFT JOIN (SELECT l_partkey, avg(nullif(l_tax, 0)) m FROM lineitem GROUP BY 1) USING (l_partkey)""")
def _(t):
    li = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", F.nullif("l_tax", F.lit(0.0)).alias("tax"))
    means = li.groupBy("l_partkey").agg(F.avg("tax").alias("m"))
    return R.rounded(li.join(means, "l_partkey", "left").select(
        "l_orderkey", "l_linenumber", "l_partkey", F.coalesce("tax", "m").alias("tax"), F.col("tax").isNull().alias("was_null")))


@query("p07_melt", """UNPIVOT (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, l_discount, l_tax FROM lineitem)
  ON l_quantity, l_discount, l_tax INTO NAME variable VALUE value""")
def _(t):
    li = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_discount", "l_tax")
    return R.melt(li, ["l_orderkey", "l_linenumber", "l_partkey"], ["l_quantity", "l_discount", "l_tax"])


@query("p08_cast_wide", """SELECT user_id, max(value) FILTER (event_type = 'click') AS click, max(value) FILTER (event_type = 'error') AS error,
  max(value) FILTER (event_type = 'purchase') AS purchase, max(value) FILTER (event_type = 'signup') AS signup,
  max(value) FILTER (event_type = 'view') AS view FROM events GROUP BY 1""")
def _(t):
    return R.cast_wide(t.events, ["user_id"], "event_type", ["click", "error", "purchase", "signup", "view"], F.max("value"))


@query("p09_round_columns", "SELECT l_orderkey, l_linenumber, l_partkey, round(l_extendedprice / 7, 3) AS a, round(l_discount / 3, 3) AS b FROM lineitem")
def _(t):
    li = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", (F.col("l_extendedprice") / 7).alias("a"), (F.col("l_discount") / 3).alias("b"))
    return R.rounded(li, 3, ["a", "b"])


@query("p10_downcast", "SELECT l_orderkey, CAST(l_linenumber AS TINYINT) AS l_linenumber, CAST(l_quantity AS FLOAT) AS l_quantity, CAST(l_tax AS FLOAT) AS l_tax FROM lineitem")
def _(t):
    return R.downcast(t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity", "l_tax"), {"double": "float", "int": "tinyint"})


@query("p11_source_tag", """SELECT * FROM (SELECT l_orderkey AS id, l_quantity AS v, 'train' AS src FROM lineitem WHERE l_shipdate < TIMESTAMP '1998-01-01'
  UNION ALL SELECT l_orderkey, l_quantity, 'test' FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-01-01') WHERE src = 'test'""")
def _(t):
    li = t.lineitem.select(F.col("l_orderkey").alias("id"), F.col("l_quantity").alias("v"), "l_shipdate")
    cut = F.lit("1998-01-01").cast("timestamp")
    both = R.tagged_union({"train": li.where(F.col("l_shipdate") < cut).drop("l_shipdate"),
                           "test": li.where(F.col("l_shipdate") >= cut).drop("l_shipdate")}, "src")
    return both.where("src = 'test'")


@query("p12_row_id", "SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS row_id FROM events")
def _(t):
    return split_window(t.events.select("event_id", "ts"), [], ["ts", "event_id"], row_number="row_id").drop("ts")


@query("p13_composed_key", "SELECT o_orderkey, o_custkey || '_' || o_orderstatus AS k FROM orders")
def _(t):
    return t.orders.select("o_orderkey", F.concat_ws("_", "o_custkey", "o_orderstatus").alias("k"))


PATH = "nullif(p_type, 'PROMO') || '/' || p_brand || CASE WHEN p_size > 25 THEN '/' || p_size ELSE '' END"


@query("p14_split_path_default", f"""SELECT p_partkey, coalesce(nullif(split_part(c, '/', 1), ''), 'other') AS a, coalesce(nullif(split_part(c, '/', 2), ''), 'other') AS b,
  coalesce(nullif(split_part(c, '/', 3), ''), 'other') AS c FROM (SELECT p_partkey, {PATH} AS c FROM part)""")
def _(t):
    path = F.concat(F.nullif("p_type", F.lit("PROMO")), F.lit("/"), F.col("p_brand"),
                    F.when(F.col("p_size") > 25, F.concat(F.lit("/"), F.col("p_size").cast("string"))).otherwise(""))
    return t.part.select("p_partkey", *R.split_path(path, "/", ["a", "b", "c"], ["other"] * 3))


@query("p15_split_path_pad", """SELECT s_suppkey, r_name AS country, CASE WHEN s_suppkey % 3 > 0 THEN n_name ELSE '' END AS state,
  CASE WHEN s_suppkey % 3 > 1 THEN s_name ELSE '' END AS dma FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def _(t):
    s = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    k = F.col("s_suppkey") % 3
    geo = F.concat_ws(">", "r_name", F.when(k > 0, F.col("n_name")), F.when(k > 1, F.col("s_name")))
    return s.select("s_suppkey", *R.split_path(geo, ">", ["country", "state", "dma"], ["", "", ""]))


@query("p16_recode", "SELECT o_orderkey, CASE o_orderstatus WHEN 'P' THEN '5' WHEN 'F' THEN '1' ELSE o_orderstatus END AS status FROM orders")
def _(t):
    return t.orders.select("o_orderkey", R.recode(F.col("o_orderstatus"), {"P": "5", "F": "1"}).alias("status"))


@query("p17_code_lookup", """SELECT c_custkey, CASE WHEN c_mktsegment = 'MACHINERY' THEN 3 WHEN c_mktsegment = 'BUILDING' THEN 1 WHEN c_mktsegment = 'AUTOMOBILE' THEN 2 ELSE -99 END AS code FROM customer""")
def _(t):
    seg = F.when(F.col("c_mktsegment") == "MACHINERY", F.lit("NA")).otherwise(F.col("c_mktsegment"))
    return t.customer.select("c_custkey", R.code_lookup(seg, {"BUILDING": 1, "AUTOMOBILE": 2}, 3, -99).alias("code"))


@query("p18_join_column_sets", """SELECT p_partkey, n AS a_n, round(q, 6) AS b_q FROM (SELECT l_partkey AS p_partkey, count(*) n FROM lineitem GROUP BY 1)
  JOIN (SELECT l_partkey AS p_partkey, avg(l_quantity) q FROM lineitem GROUP BY 1) USING (p_partkey)""")
def _(t):
    li = t.lineitem.select(F.col("l_partkey").alias("p_partkey"), "l_quantity")
    a = li.groupBy("p_partkey").agg(F.count(F.lit(1)).alias("n"))
    b = li.groupBy("p_partkey").agg(F.avg("l_quantity").alias("q"))
    return R.rounded(R.with_affix(a, "a_", keep=["p_partkey"]).join(R.with_affix(b, "b_", keep=["p_partkey"]), "p_partkey"))


@query("p19_bags_in_long_form", """SELECT l_orderkey AS bag, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS inst,
  l_quantity AS f1, l_discount AS f2, count(*) OVER (PARTITION BY l_orderkey) AS bag_size FROM lineitem""")
def _(t):
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
    li = t.lineitem.select("l_orderkey", "l_discount", *order)
    inst = split_window(li, ["l_orderkey"], order, row_number="inst")
    sizes = li.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("bag_size"))
    return inst.join(sizes, "l_orderkey").select(
        F.col("l_orderkey").alias("bag"), "inst", F.col("l_quantity").alias("f1"), F.col("l_discount").alias("f2"), "bag_size")


@query("p20_row_per_positive_label", """SELECT user_id, w, label FROM (SELECT DISTINCT user_id, CAST(date_diff('day', TIMESTAMP '2024-01-01', ts) // 7 AS BIGINT) AS w,
  event_type AS label FROM events)""")
def _(t):
    from tessera.catalog.panel import FLAGS, weekly_panel
    panel = weekly_panel(t)
    flags = F.array(*[F.when(F.col(f) == 1, F.lit(f)) for f in FLAGS])
    return panel.select("user_id", "w", F.explode(F.filter(flags, lambda x: x.isNotNull())).alias("label"))


@query("p21_indicator_code", "SELECT l_orderkey, l_linenumber, l_partkey, CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END AS code FROM lineitem")
def _(t):
    flags = [(F.col("l_returnflag") == v).cast("int") for v in ("A", "N", "R")]
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", R.indicator_code(flags).alias("code"))


@query("p22_transform_chain", "SELECT o_orderstatus AS s, count(*) AS n FROM orders WHERE o_totalprice > 100000 GROUP BY 1")
def _(t):
    def above(df, limit):
        return df.where(F.col("o_totalprice") > limit)

    def counted(df, by):
        return df.groupBy(F.col(by).alias("s")).agg(F.count(F.lit(1)).alias("n"))

    return t.orders.transform(above, limit=100000).transform(counted, by="o_orderstatus")


@query("j01_inner", basket_sql("SELECT i.order_id, product_id, user_id, order_number FROM items i JOIN ord o ON i.order_id = o.order_id"))
def _(t):
    o = basket_orders(t)
    return basket_lines(t, o).select("order_id", "product_id", "user_id", "order_number")


@query("j02_inner_composite", basket_sql("SELECT order_id, product_id, n FROM lines JOIN (SELECT user_id, aisle_id, count(*) n FROM lines GROUP BY ALL) USING (user_id, aisle_id)"))
def _(t):
    lines = basket_lines(t)
    ua = lines.groupBy("user_id", "aisle_id").agg(F.count(F.lit(1)).alias("n"))
    return lines.join(ua, ["user_id", "aisle_id"]).select("order_id", "product_id", "n")


@query("j03_left", "SELECT o_orderkey, l.l_partkey FROM orders LEFT JOIN lineitem l ON o_orderkey = l_orderkey")
def _(t):
    li = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey")
    return t.orders.select("o_orderkey").join(li, "o_orderkey", "left")


@query("j04_right_back_to_groups", """SELECT c_custkey, n_orders, c_acctbal FROM (SELECT o_custkey AS c_custkey, count(*) n_orders FROM orders GROUP BY 1)
  RIGHT JOIN customer USING (c_custkey)""")
def _(t):
    counts = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n_orders"))
    return counts.join(t.customer.select("c_custkey", "c_acctbal"), "c_custkey", "right")


@query("j05_natural", basket_sql("SELECT * FROM (SELECT user_id, product_id, count(*) AS n FROM lines GROUP BY ALL) NATURAL JOIN (SELECT user_id, max(order_number) AS m FROM lines GROUP BY 1) NATURAL JOIN prods"))
def _(t):
    lines = basket_lines(t)
    up = lines.groupBy("user_id", "product_id").agg(F.count(F.lit(1)).alias("n"))
    u = lines.groupBy("user_id").agg(F.max("order_number").alias("m"))
    return J.natural_join(J.natural_join(up, u), products(t))


@query("j06_keyed_merge", "SELECT s_suppkey, n_name, count(l_orderkey) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey LEFT JOIN lineitem ON s_suppkey = l_suppkey GROUP BY ALL")
def _(t):
    n = t.lineitem.groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count(F.lit(1)).alias("n"))
    s = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_name")
    return s.join(n, "s_suppkey", "left").fillna(0, ["n"])


@query("j07_first_match", """SELECT p_partkey, supp FROM part LEFT JOIN (SELECT l_partkey, min(l_suppkey) AS supp FROM lineitem GROUP BY 1) ON p_partkey = l_partkey""")
def _(t):
    li = t.lineitem.select(F.col("l_partkey").alias("p_partkey"), F.col("l_suppkey").alias("supp"))
    return J.first_match(t.part.select("p_partkey"), li, "p_partkey", "supp", "supp")


@query("j08_lookup_with_default", """SELECT c_custkey, coalesce(n, 0) AS n, coalesce(m, -1.0) AS m FROM customer LEFT JOIN
  (SELECT o_custkey, count(*) n, max(o_totalprice) m FROM orders GROUP BY 1) ON c_custkey = o_custkey""")
def _(t):
    dim = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.count(F.lit(1)).alias("n"), F.max("o_totalprice").alias("m"))
    return J.lookup_with_default(t.customer.select("c_custkey"), dim, ["c_custkey"], {"n": 0, "m": -1.0})


@query("j09_listed_flag", """SELECT event_id, CAST(k % 10 = user_id % 10 OR k % 10 = (user_id + 7) % 10 AS INT) AS listed
  FROM (SELECT event_id, user_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)""")
def _(t):
    ev = t.events.select("event_id", (F.get_json_object("props", "$.k").cast("long") % 10).cast("string").alias("doc"),
                         F.col("user_id").cast("string").alias("uuid"))
    # one list per document: the users whose last digit is the document's or three after it
    users = t.events.select("user_id").distinct().select(
        F.explode(F.array((F.col("user_id") % 10).cast("string"), ((F.col("user_id") + 7) % 10).cast("string"))).alias("doc"),
        F.col("user_id").cast("string").alias("uuid"))
    lists = users.groupBy("doc", F.substring("uuid", -2, 2).alias("part")).agg(F.array_join(F.sort_array(F.collect_set("uuid")), " ").alias("uuids"))
    return J.listed_flag(ev, lists, "doc", "uuid", "uuids", "listed").select("event_id", "listed")


@query("j10_anti", basket_sql("SELECT order_id FROM ord WHERE order_id NOT IN (SELECT order_id FROM lines WHERE reordered = 1)"))
def _(t):
    o = basket_orders(t)
    return o.select("order_id").join(basket_lines(t, o).where("reordered = 1").select("order_id"), "order_id", "left_anti")


@query("j11_star", basket_sql("""SELECT order_id, product_id, a, b, c, d FROM lines
  LEFT JOIN (SELECT user_id, count(*) a FROM lines GROUP BY 1) USING (user_id) LEFT JOIN (SELECT product_id, count(*) b FROM lines WHERE cart_pos = 1 GROUP BY 1) USING (product_id)
  LEFT JOIN (SELECT user_id, aisle_id, count(*) c FROM lines WHERE reordered = 1 GROUP BY ALL) USING (user_id, aisle_id)
  LEFT JOIN (SELECT order_id, count(*) d FROM lines GROUP BY 1) USING (order_id)"""))
def _(t):
    lines = basket_lines(t)
    n = lambda df, keys, name: (df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name)), keys)
    return J.star_join(lines, [n(lines, ["user_id"], "a"), n(lines.where("cart_pos = 1"), ["product_id"], "b"),
                               n(lines.where("reordered = 1"), ["user_id", "aisle_id"], "c"), n(lines, ["order_id"], "d")]
                       ).select("order_id", "product_id", "a", "b", "c", "d")


@query("j12_self_lag_join", """WITH p AS (SELECT DISTINCT user_id, CAST(date_diff('day', TIMESTAMP '2024-01-01', ts) // 7 AS BIGINT) AS w, event_type = 'click' AS c FROM events),
  q AS (SELECT user_id, w, CAST(max(c) AS INT) AS click FROM p GROUP BY ALL)
  SELECT a.user_id, a.w, a.click, coalesce(b.click, 0) AS click_1, coalesce(c.click, 0) AS click_2 FROM q a
  LEFT JOIN q b ON a.user_id = b.user_id AND a.w = b.w + 1 LEFT JOIN q c ON a.user_id = c.user_id AND a.w = c.w + 2""")
def _(t):
    from tessera.catalog.panel import weekly_panel
    panel = weekly_panel(t).select("user_id", "w", "click")
    out = panel
    for by in (1, 2):
        out = out.join(J.shift_rows(panel, ["user_id"], "w", by, ["click"], f"_{by}"), ["user_id", "w"], "left")
    return out.fillna(0, ["click_1", "click_2"])


SET_DISTANCE = """base AS (SELECT user_id, order_number, order_id, product_id FROM lines), sz AS (SELECT order_id, count(*) n FROM base GROUP BY 1),
  link AS (SELECT a.order_id AS id, b.order_id AS id2, b.order_dow AS class FROM ord a JOIN ord b ON a.user_id = b.user_id
    AND b.order_number - a.order_number BETWEEN 1 AND 3 WHERE a.order_id <> b.order_id),
  common AS (SELECT id, id2, count(*) c FROM link JOIN base x ON x.order_id = id JOIN base y ON y.order_id = id2 AND x.product_id = y.product_id GROUP BY ALL),
  dist AS (SELECT id, id2, class, coalesce(c, 0) / (x.n + y.n - coalesce(c, 0)) AS jaccard, 2 * coalesce(c, 0) / (x.n + y.n) AS dice
    FROM link JOIN sz x ON x.order_id = id JOIN sz y ON y.order_id = id2 LEFT JOIN common USING (id, id2))"""


@query("j13_linked_set_distance", basket_sql("SELECT id, id2, round(jaccard, 6) AS jaccard, round(dice, 6) AS dice FROM dist", SET_DISTANCE))
def _(t):
    from tessera.catalog.panel import basket_links
    from tessera.operators.similarity import linked_set_distance
    sets, links = basket_links(t)
    return R.rounded(linked_set_distance(sets, links).select("id", "id2", "jaccard", "dice"))


SIMILAR_SETS = """held AS (SELECT DISTINCT l_orderkey AS id, l_partkey AS item FROM lineitem),
  side AS (SELECT h.id, item, eval_set = 'test' AS asked, order_dow AS class, count(*) OVER (PARTITION BY h.id) AS n FROM held h JOIN ord ON ord.order_id = h.id),
  pairs AS (SELECT a.id, b.id AS id2, b.class, count(*) / (max(a.n) + max(b.n) - count(*)) AS jaccard, 2 * count(*) / (max(a.n) + max(b.n)) AS dice
    FROM side a JOIN side b ON a.item = b.item AND a.asked AND NOT b.asked GROUP BY ALL),
  alike AS (SELECT * FROM pairs WHERE jaccard >= 0.2)"""


def order_sets(t):
    """Parts of each order: those of users' last orders, those of all others, and the others' classes."""
    orders = cut_lineage(basket_orders(t).select(
        F.col("order_id").alias("id"), (F.col("n_orders") == F.col("order_number")).alias("asked"), F.col("order_dow").alias("class")))
    with shuffles_for(t.spark, t.lineitem.count()):
        held = cut_lineage(t.lineitem.select(F.col("l_orderkey").alias("id"), F.col("l_partkey").alias("item")).join(orders, "id"))
    return held.where("asked").select("id", "item"), held.where("not asked").select("id", "item"), orders.where("not asked").select("id", "class")


@query("j13_similar_sets", basket_sql("SELECT id, id2, round(jaccard, 6) AS jaccard, round(dice, 6) AS dice FROM alike", SIMILAR_SETS))
def _(t):
    from tessera.operators.set_join import set_pairs
    asked, others, _ = order_sets(t)
    return R.rounded(set_pairs(asked, others, 20))


EDGES = """e0 AS (SELECT DISTINCT a.l_partkey AS a, b.l_partkey AS b FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey
    AND b.l_linenumber = a.l_linenumber + 1 WHERE a.l_partkey <> b.l_partkey),
  adj AS (SELECT a AS src, b AS dst FROM e0 UNION SELECT b, a FROM e0)"""


@query("j14_common_neighbours", f"""WITH {EDGES} SELECT a, b, (SELECT 0) + coalesce(c, 0) AS common FROM e0 LEFT JOIN
  (SELECT a, b, count(*) c FROM e0 JOIN adj x ON x.src = a JOIN adj y ON y.src = b AND x.dst = y.dst GROUP BY ALL) USING (a, b)""")
def _(t):
    from tessera.catalog.panel import part_pairs
    return J.common_neighbours(part_pairs(t), "a", "b")
