"""Windows and sequences (W1-W18), sorts, top-k and set operations."""

from pyspark.sql import functions as F

from tessera.catalog.aggregate_queries import CLICKS, clicks
from tessera.catalog.base import query
from tessera.catalog.basket_queries import MARKOV
from tessera.catalog.panel import FLAGS, PANEL, weekly_panel
from tessera.catalog.views import basket_lines, basket_orders, basket_sql
from tessera.operators import aggregates as A
from tessera.operators import sequences as S
from tessera.operators import topk as T
from tessera.operators.frames import rounded, tagged_union
from tessera.operators.ranges import average_rank, dense_codes, split_window



@query("w01_row_number", basket_sql("SELECT order_id, product_id, row_number() OVER (PARTITION BY user_id, product_id ORDER BY order_number) AS product_time FROM lines"))
def _(t):
    return split_window(basket_lines(t), ["user_id", "product_id"], ["order_number", "order_id"],
                        row_number="product_time").select("order_id", "product_id", "product_time")


@query("w02_last_three", basket_sql("SELECT order_id, user_id, order_number FROM ord WHERE n_orders - order_number < 3"))
def _(t):
    return S.last_rows(basket_orders(t), ["user_id"], ["order_number"], 3).select("order_id", "user_id", "order_number")


@query("w03_rows_two_to_four", basket_sql("SELECT order_id, user_id, order_number FROM ord WHERE order_number BETWEEN 2 AND 4"))
def _(t):
    return S.rows_between(basket_orders(t), ["user_id"], ["order_number"], 2, 4).select("order_id", "user_id", "order_number")


@query("w04_penultimate", basket_sql("SELECT order_id, user_id, order_number FROM ord WHERE n_orders - order_number = 1"))
def _(t):
    return S.nth_from_last(basket_orders(t), ["user_id"], ["order_number"], 2).select("order_id", "user_id", "order_number")


@query("w05_last_two_mean", basket_sql("SELECT user_id, round(avg(days_since_prior), 6) AS m FROM ord WHERE n_orders - order_number < 2 GROUP BY 1"))
def _(t):
    two = S.last_rows(basket_orders(t), ["user_id"], ["order_number"], 2)
    return rounded(two.groupBy("user_id").agg(F.avg("days_since_prior").alias("m")))


@query("w06_previous_basket", basket_sql("""SELECT user_id, order_number, string_agg(CAST(product_id AS VARCHAR), ' ' ORDER BY product_id) AS previous
  FROM (SELECT user_id, order_number + 1 AS order_number, product_id, n_orders FROM lines) WHERE order_number <= n_orders GROUP BY ALL"""))
def _(t):
    before = basket_lines(t).select("user_id", (F.col("order_number") + 1).alias("order_number"), "product_id", "n_orders").where("order_number <= n_orders")
    return T.joined_ids(before, ["user_id", "order_number"], "product_id", "previous")


@query("w07_cumulative_sum", basket_sql("SELECT order_id, CAST(sum(days_since_prior) OVER (PARTITION BY user_id ORDER BY order_number) AS BIGINT) AS days FROM ord"))
def _(t):
    o = basket_orders(t)
    return split_window(o, ["user_id"], ["order_number", "order_id"], sums={"days": "days_since_prior"}).select("order_id", "days")


@query("w08_difference_to_previous", "SELECT o_orderkey, round(coalesce(o_totalprice - lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), 0), 2) AS d FROM orders")
def _(t):
    lagged = split_window(t.orders, ["o_custkey"], ["o_orderdate", "o_orderkey"], lags={"before": "o_totalprice"})
    return lagged.select("o_orderkey", F.round(F.coalesce(F.col("o_totalprice") - F.col("before"), F.lit(0.0)), 2).alias("d"))


@query("w09_partition_maximum", "SELECT o_orderkey, max(o_totalprice) OVER (PARTITION BY o_custkey) AS m FROM orders")
def _(t):
    return A.with_group_max(t.orders, ["o_custkey"], "o_totalprice", "m").select("o_orderkey", "m")


@query("w10_second_highest", basket_sql("""SELECT user_id, product_id, coalesce(max(CASE WHEN r = 2 THEN order_number END), 0) AS second FROM
  (SELECT user_id, product_id, order_number, dense_rank() OVER (PARTITION BY user_id, product_id ORDER BY order_number DESC) r FROM lines) GROUP BY ALL"""))
def _(t):
    return A.second_highest(basket_lines(t), ["user_id", "product_id"], "order_number", "second")


@query("w11_since_last", basket_sql("""SELECT user_id, product_id, n_orders - max(order_number) AS since_last, round(count(*) / (n_orders - min(order_number) + 1), 6) AS rate
  FROM lines GROUP BY user_id, product_id, n_orders"""))
def _(t):
    g = basket_lines(t).groupBy("user_id", "product_id").agg(F.max("n_orders").alias("k"), F.max("order_number").alias("hi"), F.min("order_number").alias("lo"), F.count("*").alias("n"))
    return rounded(g.select("user_id", "product_id", (F.col("k") - F.col("hi")).alias("since_last"), F.try_divide(F.col("n"), F.col("k") - F.col("lo") + 1).alias("rate")))


@query("w12_state_weeks_back", f"""WITH {PANEL} SELECT a.user_id, {', '.join(f'coalesce(b{k}.click, 0) AS click_{k}, coalesce(b{k}.view, 0) AS view_{k}' for k in (1, 2, 3))}
  FROM (SELECT DISTINCT user_id FROM pn) a {' '.join(f'LEFT JOIN pn b{k} ON a.user_id = b{k}.user_id AND b{k}.w = 4 - {k}' for k in (1, 2, 3))}""")
def _(t):
    now = 4
    state = lambda f, k: F.coalesce(F.max(F.when(F.col("w") == now - k, F.col(f))), F.lit(0)).alias(f"{f}_{k}")
    return weekly_panel(t).groupBy("user_id").agg(*[state(f, k) for k in (1, 2, 3) for f in ("click", "view")])


@query("w13_added_flags", f"""WITH {PANEL}, m AS (UNPIVOT pn ON click, error, purchase, signup, view INTO NAME product VALUE has)
  SELECT a.user_id, a.w, a.product, greatest(a.has - coalesce(b.has, 0), 0) AS added FROM m a LEFT JOIN m b ON a.user_id = b.user_id AND a.product = b.product AND a.w = b.w + 1""")
def _(t):
    long = weekly_panel(t).unpivot(["user_id", "w"], FLAGS, "product", "has")
    before = long.select("user_id", "product", (F.col("w") + 1).alias("w"), F.col("has").alias("had"))
    joined = long.join(before, ["user_id", "product", "w"], "left")
    return joined.select("user_id", "w", "product", F.greatest(F.col("has") - F.coalesce("had", F.lit(0)), F.lit(0)).alias("added"))


@query("w14_months_between", "SELECT l_orderkey, l_linenumber, l_partkey, CAST(12 * (year(l_shipdate) - year(o_orderdate)) + month(l_shipdate) - month(o_orderdate) AS INT) AS months FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def _(t):
    j = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return j.select("l_orderkey", "l_linenumber", "l_partkey", S.months_between(F.col("l_shipdate"), F.col("o_orderdate")).alias("months"))


@query("w15_percentile_rank", """SELECT l_orderkey, l_linenumber, l_partkey, round((rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2) / count(*) OVER (), 6) AS pr FROM lineitem""")
def _(t):
    ranks = average_rank(t.lineitem, "l_extendedprice", "r").drop("ties")
    n = t.lineitem.agg(F.count("*")).scalar()
    return rounded(t.lineitem.join(ranks, "l_extendedprice").select("l_orderkey", "l_linenumber", "l_partkey", (F.col("r") / n).alias("pr")))


@query("w16_factor_codes", "SELECT p_partkey, dense_rank() OVER (ORDER BY p_name) AS code FROM part")
def _(t):
    return t.part.join(dense_codes(t.part, "p_name", "code"), "p_name").select("p_partkey", "code")


PRED = """pr AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_returnflag = 'R' AS INT) AS y, round(0.1 + 0.8 * l_quantity / 50, 6) AS p1, round(0.9 - 8 * l_discount, 6) AS p2, round(0.05 + l_tax * 10, 6) AS p3,
  l_orderkey * 1000000 + l_linenumber * 100000 + l_partkey AS id FROM lineitem)"""


def predictions(t):
    """Three prediction columns in (0, 1) and a label for every order line."""
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (F.col("l_returnflag") == "R").cast("int").alias("y"),
        F.round(0.1 + 0.8 * F.col("l_quantity") / 50, 6).alias("p1"), F.round(0.9 - 8 * F.col("l_discount"), 6).alias("p2"),
        F.round(0.05 + F.col("l_tax") * 10, 6).alias("p3"),
        (F.col("l_orderkey") * 1000000 + F.col("l_linenumber") * 100000 + F.col("l_partkey")).alias("id"))


GINI = """g AS (SELECT (sum(c) / sum(y) - (count(*) + 1) / 2) / count(*) AS gini FROM (SELECT y, sum(y) OVER (ORDER BY p1 DESC, id, l_suppkey ROWS UNBOUNDED PRECEDING) c FROM pr)),
  h AS (SELECT (sum(c) / sum(y) - (count(*) + 1) / 2) / count(*) AS perfect FROM (SELECT y, sum(y) OVER (ORDER BY y DESC, id ROWS UNBOUNDED PRECEDING) c FROM pr))"""


@query("w17_cumulative_gain", f"WITH {PRED}, r AS (SELECT id, y, sum(y) OVER (ORDER BY p1 DESC, id, l_suppkey) AS hits FROM pr) SELECT hits, count(*) AS n FROM r GROUP BY 1")
def _(t):
    base = predictions(t).select("id", "l_suppkey", "y", (-F.col("p1")).alias("o"))
    return split_window(base, [], ["o", "id", "l_suppkey"], sums={"hits": "y"}).groupBy("hits").agg(F.count("*").alias("n"))


@query("w18_rank_within_display", f"WITH {CLICKS} SELECT k AS display, ad, row_number() OVER (PARTITION BY k ORDER BY avg(clicked) DESC, ad) AS pos FROM clicks GROUP BY k, ad")
def _(t):
    c = clicks(t).groupBy(F.col("k").alias("display"), "ad").agg(F.avg("clicked").alias("rate"))
    c = c.withColumn("low", -F.col("rate"))
    return split_window(c, ["display"], ["low", "ad"], row_number="pos").select("display", "ad", "pos")


@query("t01_sort", "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber")
def _(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_extendedprice").orderBy(F.col("l_extendedprice").desc(), "l_orderkey", "l_linenumber")


@query("t02_top_n_names", "SELECT l_partkey, n, p_name FROM (SELECT l_partkey, count(*) n FROM lineitem GROUP BY 1 ORDER BY n DESC, l_partkey LIMIT 10) JOIN part ON l_partkey = p_partkey")
def _(t):
    n = t.lineitem.groupBy("l_partkey").agg(F.count("*").alias("n"))
    top = T.top_n(n, [F.col("n").desc(), F.col("l_partkey")], 10)
    return top.join(t.part.select(F.col("p_partkey").alias("l_partkey"), "p_name").distinct(), "l_partkey")


SCORES = [("a", "l_quantity / 50"), ("b", "l_discount * 10"), ("c", "l_tax * 12.5"), ("d", "l_extendedprice / 100000"), ("e", "l_linenumber / 7.0")]


@query("t03_top_columns_per_row", f"""WITH n AS (SELECT *, row_number() OVER () AS rid FROM lineitem), s AS (SELECT rid, l_orderkey, l_linenumber, l_partkey, unnest([{', '.join(f"{{'n': '{n}', 's': round({e}, 6)}}" for n, e in SCORES)}]) AS x FROM n),
  r AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY x.s DESC, x.n) k FROM s)
  SELECT l_orderkey, l_linenumber, l_partkey, string_agg(x.n, ' ' ORDER BY k) AS products FROM r WHERE k <= 3 GROUP BY rid, l_orderkey, l_linenumber, l_partkey""")
def _(t):
    df = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *[F.round(F.expr(e).cast("double"), 6).alias(n) for n, e in SCORES])
    return T.top_columns(df, ["l_orderkey", "l_linenumber", "l_partkey"], [n for n, _ in SCORES], 3)


@query("t04_mask_owned", f"""WITH {PANEL} SELECT user_id, w, greatest(round(0.9::DOUBLE - 0.1 * w::DOUBLE, 6) - click, 0) AS click, greatest(round(0.5::DOUBLE + 0.05 * w::DOUBLE, 6) - view, 0) AS view FROM pn""")
def _(t):
    p = weekly_panel(t)
    mask = lambda score, owned: F.greatest(F.round(score, 6) - F.col(owned), F.lit(0.0)).alias(owned)
    return p.select("user_id", "w", mask(0.9 - 0.1 * F.col("w"), "click"), mask(0.5 + 0.05 * F.col("w"), "view"))


@query("t05_keep_frequent", """SELECT p_partkey, CASE WHEN p_name IN (SELECT p_name FROM part GROUP BY 1 ORDER BY count(*) DESC, p_name LIMIT 10) THEN p_name ELSE 'other' END AS p_name FROM part""")
def _(t):
    return T.keep_frequent(t.part.select("p_partkey", "p_name"), "p_name", 10, "other")


@query("t06_union_all", "SELECT o_orderkey AS k, o_totalprice AS v, NULL AS extra, 'o' AS src FROM orders UNION ALL SELECT c_custkey, c_acctbal, c_mktsegment, 'c' FROM customer")
def _(t):
    return tagged_union({
        "o": t.orders.select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("v")),
        "c": t.customer.select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"), F.col("c_mktsegment").alias("extra"))}, "src")


@query("t07_distinct", "SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem")
def _(t):
    return t.lineitem.select("l_orderkey", "l_linenumber").dropDuplicates()


@query("t08_distinct_text_ids", "SELECT doc_id, dense_rank() OVER (ORDER BY text) AS qid FROM documents")
def _(t):
    return t.documents.join(dense_codes(t.documents, "text", "qid"), "text").select("doc_id", "qid")


TRANSITIONS = MARKOV.format(src="lines", n="count(*) FILTER (order_number > 1)", osrc="true")


@query("t09_consecutive_baskets", basket_sql("""SELECT user_id, order_number, count(*) FILTER (before AND now) AS kept, count(*) FILTER (now AND NOT before) AS added,
  count(*) FILTER (before AND NOT now) AS dropped FROM tr GROUP BY ALL""", TRANSITIONS))
def _(t):
    b, n = F.col("before"), F.col("now")
    return S.consecutive_baskets(basket_lines(t)).groupBy("user_id", "order_number").agg(
        F.sum(b * n).alias("kept"), F.sum(n * (1 - b)).alias("added"), F.sum(b * (1 - n)).alias("dropped"))


@query("t10_transition_table", basket_sql('SELECT product_id, round("P0", 6) AS "P0", round("P00", 6) AS "P00", round("P01", 6) AS "P01", round("P1", 6) AS "P1", round("P10", 6) AS "P10", round("P11", 6) AS "P11" FROM trans', TRANSITIONS))
def _(t):
    o = basket_orders(t)
    return rounded(S.transition_table(basket_lines(t, o), o))


@query("t10_transition_table_as_written", basket_sql('SELECT product_id, round("P0", 6) AS "P0", round("P00", 6) AS "P00", round("P01", 6) AS "P01", round("P1", 6) AS "P1", round("P10", 6) AS "P10", round("P11", 6) AS "P11" FROM trans',
       MARKOV.format(src="lines", n="CAST(sum(n_orders - 1) AS BIGINT)", osrc="true")))
def _(t):
    o = basket_orders(t)
    return rounded(S.transition_table(basket_lines(t, o), o, as_written=True))


@query("t11_transition_by_state", basket_sql("""SELECT order_id, product_id, reordered, round(CASE reordered WHEN 1 THEN "P1" ELSE "P0" END, 6) AS "P0", round(CASE reordered WHEN 1 THEN "P10" ELSE "P00" END, 6) AS "P1",
  round(CASE reordered WHEN 1 THEN "P11" ELSE "P01" END, 6) AS "P2" FROM lines LEFT JOIN trans USING (product_id) WHERE order_number = n_orders""", TRANSITIONS))
def _(t):
    o = basket_orders(t)
    lines = basket_lines(t, o)
    rows = S.state_rows(S.transition_table(lines, o))
    now = lines.where("order_number = n_orders").select("order_id", "product_id", "reordered")
    return rounded(now.join(rows, ["product_id", "reordered"], "left"))
