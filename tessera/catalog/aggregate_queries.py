"""Aggregations."""

from pyspark.sql import functions as F

from tessera.catalog.base import query
from tessera.catalog.panel import FLAGS, PANEL, basket_links, weekly_panel
from tessera.catalog.relational_queries import SET_DISTANCE, SIMILAR_SETS, order_sets
from tessera.catalog.views import basket_lines, basket_orders, basket_sql, products
from tessera.functions.text import ascii_words, letter_words
from tessera.operators import aggregates as A
from tessera.operators.encoders import column_quantiles
from tessera.operators.frames import rounded
from tessera.operators import sketches as K
from tessera.operators.ranges import group_quantiles, number_chunks
from tessera.operators.set_join import class_distances
from tessera.operators.similarity import linked_set_distance
from tessera.operators.topk import joined_ids, top_n
from tessera.session import cut_lineage

WORDS = "regexp_extract_all(lower(text), '[a-z0-9]+')"
LETTER_WORDS = r"regexp_extract_all(lower(text), '[\pL\pN]+')"


@query("a01_basic", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_extendedprice), 2) AS s, min(l_quantity) AS lo, max(l_quantity) AS hi, round(avg(l_discount), 6) AS m FROM lineitem GROUP BY ALL")
def _(t):
    return t.lineitem.groupBy("l_returnflag", "l_linestatus").agg(
        F.count("*").alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("s"), F.min("l_quantity").alias("lo"),
        F.max("l_quantity").alias("hi"), F.round(F.avg("l_discount"), 6).alias("m"))


@query("a02_count_distinct", "SELECT l_suppkey, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_orderkey) AS orders FROM lineitem GROUP BY 1")
def _(t):
    return t.lineitem.groupBy("l_suppkey").agg(F.count_distinct("l_partkey").alias("parts"), F.count_distinct("l_orderkey").alias("orders"))


@query("a02_distinct_sketches", "SELECT event_type, count(DISTINCT user_id) AS users, true AS within FROM events GROUP BY 1")
def _(t):
    """Users per event type from sketches per (type, day), next to the exact count: within 6 %."""
    daily = cut_lineage(K.distinct_sketches(t.events.withColumn("day", F.to_date("ts")), ["event_type", "day"], ["user_id"]))
    merged = K.merged_distinct(daily, ["event_type"], ["user_id"]).withColumnRenamed("user_id", "sketched")
    exact = t.events.groupBy("event_type").agg(F.countDistinct("user_id").alias("users"))
    return exact.join(merged, "event_type").select("event_type", "users", (F.abs(F.col("sketched") - F.col("users")) <= 0.06 * F.col("users")).alias("within"))


@query("a24_quantile_sketches", "SELECT l_returnflag, count(*) AS rows, true AS median_within, true AS high_within FROM lineitem GROUP BY 1")
def _(t):
    """Median and 0.9 quantile of price per flag from sketches per (flag, ship month): ranks within 2 %."""
    lines = t.lineitem.select("l_returnflag", F.trunc("l_shipdate", "month").alias("month"), F.col("l_extendedprice").cast("double").alias("x"))
    monthly = cut_lineage(K.quantile_sketches(lines, ["l_returnflag", "month"], ["x"]))
    found = cut_lineage(K.merged_quantiles(monthly, ["l_returnflag"], {"median": ("x", 0.5), "high": ("x", 0.9)}))
    near = lambda at, q: (F.avg((F.col("x") < F.col(at)).cast("int")) <= q + 0.02) & (F.avg((F.col("x") <= F.col(at)).cast("int")) >= q - 0.02)
    return lines.join(found, "l_returnflag").groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("rows"), near("median", 0.5).alias("median_within"), near("high", 0.9).alias("high_within"))


@query("a03_conditional_sum", basket_sql("SELECT product_id, CAST(sum(reordered) AS BIGINT) AS again, count(*) FILTER (cart_pos = 1) AS firsts FROM lines GROUP BY 1"))
def _(t):
    return basket_lines(t).groupBy("product_id").agg(F.count_if(F.col("reordered") == 1).alias("again"), F.count_if(F.col("cart_pos") == 1).alias("firsts"))


@query("a04_median", "SELECT l_returnflag, round(median(l_extendedprice), 6) AS med, round(quantile_cont(l_extendedprice, 0.25), 6) AS q1 FROM lineitem GROUP BY 1")
def _(t):
    return rounded(group_quantiles(t.lineitem, ["l_returnflag"], "l_extendedprice", {"med": 0.5, "q1": 0.25}))


@query("a05_sample_variance", "SELECT l_suppkey, round(var_samp(l_quantity), 6) AS v FROM lineitem GROUP BY 1")
def _(t):
    return rounded(t.lineitem.groupBy("l_suppkey").agg(F.var_samp("l_quantity").alias("v")))


def mode_rows(value, src="ord"):
    return f"SELECT user_id, {value}, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, {value}) r FROM {src} GROUP BY user_id, {value}"


@query("a06_mode", basket_sql(f"SELECT order_id, m AS mode_dow FROM ord JOIN (SELECT user_id, order_dow AS m FROM ({mode_rows('order_dow')}) WHERE r = 1) USING (user_id)"))
def _(t):
    o = basket_orders(t)
    return o.join(A.mode_per_key(o, ["user_id"], "order_dow", "mode_dow"), "user_id").select("order_id", "mode_dow")


@query("a07_mode_position", basket_sql(f"""SELECT user_id, count(*) FILTER (d <= m) AS pos FROM (SELECT DISTINCT user_id, order_dow AS d FROM ord)
  JOIN (SELECT user_id, order_dow AS m FROM ({mode_rows('order_dow')}) WHERE r = 1) USING (user_id) GROUP BY 1"""))
def _(t):
    return A.mode_position(basket_orders(t), ["user_id"], "order_dow", "pos")


@query("a08_two_level_mean", basket_sql("SELECT user_id, round(avg(n), 6) AS mean_order_size FROM (SELECT user_id, order_id, count(*) n FROM lines GROUP BY ALL) GROUP BY 1"))
def _(t):
    sizes = basket_lines(t).groupBy("user_id", "order_id").agg(F.count("*").alias("n"))
    return rounded(sizes.groupBy("user_id").agg(F.avg("n").alias("mean_order_size")))


@query("a09_many_functions", "SELECT l_suppkey, " + ", ".join(
    f"round({f}({c}), 6) AS {c}_{f}" for c in ("l_quantity", "l_discount", "l_tax") for f in ("avg", "median", "min", "max")) + " FROM lineitem GROUP BY 1")
def _(t):
    # quantity, discount and tax take few distinct values, so the medians stay small
    aggs = [getattr(F, f)(c).alias(f"{c}_{f}") for c in ("l_quantity", "l_discount", "l_tax") for f in ("avg", "median", "min", "max")]
    return rounded(t.lineitem.groupBy("l_suppkey").agg(*aggs))


@query("a10_parent_share", basket_sql("""SELECT department_id, product_id, n, CAST(sum(n) OVER (PARTITION BY department_id) AS BIGINT) AS parent_n,
    round(n / sum(n) OVER (PARTITION BY department_id), 6) AS n_ratio, users, parent_users, round(users / parent_users, 6) AS users_ratio
  FROM (SELECT department_id, product_id, count(*) n, count(DISTINCT user_id) users FROM lines GROUP BY ALL)
  JOIN (SELECT department_id, count(DISTINCT user_id) parent_users FROM lines GROUP BY 1) USING (department_id)"""))
def _(t):
    return rounded(A.parent_share(basket_lines(t), "department_id", "product_id"))


@query("a11_repeat_buyers", basket_sql("""SELECT product_id, CAST(sum(r) AS BIGINT) AS repeat_users, round(avg(r), 6) AS repeat_ratio
  FROM (SELECT product_id, user_id, max(reordered) r FROM lines GROUP BY ALL) GROUP BY 1 HAVING sum(r) > 0"""))
def _(t):
    return rounded(A.repeat_buyers(basket_lines(t), "product_id"))


@query("a12_reorder_probability", basket_sql("""SELECT product_id, count(*) AS p_orders, count(*) FILTER (k = 1) AS p_user, CAST(sum(reordered) AS BIGINT) AS p_reorders,
  round(count(*) FILTER (k = 2) / count(*) FILTER (k = 1), 6) AS p_reorder_probability, round(1 + sum(reordered) / count(*) FILTER (k = 1), 6) AS p_reorder_times,
  round(sum(reordered) / count(*), 6) AS p_reorder_ratio FROM (SELECT *, row_number() OVER (PARTITION BY user_id, product_id ORDER BY order_number) k FROM lines) GROUP BY 1"""))
def _(t):
    return rounded(A.reorder_stats(basket_lines(t), "p_"))


@query("a13_mean_user_indicator", basket_sql("SELECT product_id, round(avg(r), 6) AS reorder_prob FROM (SELECT product_id, user_id, max(reordered) r FROM lines GROUP BY ALL) GROUP BY 1"))
def _(t):
    per = basket_lines(t).groupBy("product_id", "user_id").agg(F.max("reordered").alias("r"))
    return rounded(per.groupBy("product_id").agg(F.avg("r").alias("reorder_prob")))


@query("a14_group_list", basket_sql("SELECT order_id, CAST(0 AS BIGINT) AS chunk, list(product_id ORDER BY product_id) AS items FROM lines GROUP BY 1"))
def _(t):
    return number_chunks(basket_lines(t), ["order_id"], "product_id")


@query("a15_group_concat", basket_sql("SELECT order_id, string_agg(CAST(product_id AS VARCHAR), ' ' ORDER BY cart_pos, CAST(product_id AS VARCHAR)) AS products FROM lines GROUP BY 1"))
def _(t):
    return joined_ids(basket_lines(t), ["order_id"], "product_id", "products", order="cart_pos")


DEMAND = """dm AS (SELECT CAST(month(l_shipdate) AS INT) AS week, o_custkey AS client, l_partkey AS product, l_suppkey AS agency, c_nationkey AS route, l_quantity AS demand
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey)"""


def demand(t):
    o = t.orders.select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("client"))
    c = t.customer.select(F.col("c_custkey").alias("client"), F.col("c_nationkey").alias("route"))
    return t.lineitem.join(o, "l_orderkey").join(c, "client").select(
        F.month("l_shipdate").alias("week"), "client", F.col("l_partkey").alias("product"),
        F.col("l_suppkey").alias("agency"), "route", F.col("l_quantity").alias("demand"))


def counts_sql(groups):
    cols = ", ".join(f"count(*) OVER (PARTITION BY {', '.join(g)}) AS n_{'_'.join(g)}" for g in groups)
    return f"WITH {DEMAND} SELECT client, product, demand, {cols} FROM dm"


def counts_query(t, groups):
    df = A.with_group_counts(cut_lineage(demand(t)), {f"n_{'_'.join(g)}": g for g in groups})
    return df.select("client", "product", "demand", *[f"n_{'_'.join(g)}" for g in groups])


ONE_WAY = [["week"], ["client"], ["product"], ["agency"], ["route"]]
TWO_WAY = [["week", "client"], ["week", "product"], ["client", "product"], ["agency", "route"], ["agency", "product"]]
THREE_WAY = [["week", "agency", "route"], ["product", "agency", "route"], ["week", "client", "agency"]]


@query("a16_one_way_counts", counts_sql(ONE_WAY))
def _(t):
    return counts_query(t, ONE_WAY)


@query("a17_two_way_counts", counts_sql(TWO_WAY))
def _(t):
    return counts_query(t, TWO_WAY)


@query("a18_three_way_counts", counts_sql(THREE_WAY))
def _(t):
    return counts_query(t, THREE_WAY)


@query("a19_hierarchical_means", f"""WITH {DEMAND} SELECT product, route, round(any_value(pr), 6) AS pr, round(any_value(p), 6) AS p, round(any_value(m), 6) AS m FROM
  (SELECT product, route, avg(ln(1 + demand)) pr FROM dm GROUP BY ALL) JOIN (SELECT product, avg(ln(1 + demand)) p FROM dm GROUP BY 1) USING (product),
  (SELECT avg(ln(1 + demand)) m FROM dm) GROUP BY ALL""")
def _(t):
    df = demand(t).withColumn("y", F.log1p("demand"))
    means = A.hierarchical_means(df, "y", {"m": [], "p": ["product"], "pr": ["product", "route"]})
    return rounded(means["pr"].join(means["p"], "product").withColumn("m", means["m"].scalar()))


CLICKS = "clicks AS (SELECT event_id, user_id AS ad, CAST(event_type = 'click' AS INT) AS clicked, CAST(json_extract(props, '$.k') AS BIGINT) AS k, hour(ts) AS h FROM events)"


def clicks(t):
    return t.events.select("event_id", F.col("user_id").alias("ad"), (F.col("event_type") == "click").cast("int").alias("clicked"),
                           F.get_json_object("props", "$.k").cast("long").alias("k"), F.hour("ts").alias("h"))


@query("a20_smoothed_rate", f"WITH {CLICKS} SELECT ad, round((sum(clicked) + 12 * (SELECT avg(clicked) FROM clicks)) / (count(*) + 12), 6) AS rate FROM clicks GROUP BY 1")
def _(t):
    return rounded(A.smoothed_rate(clicks(t), "ad", "clicked", 12, "rate"))


CLAIM = "cl AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_discount, CAST(l_returnflag = 'R' AS INT) AS target FROM lineitem)"


@query("a21_target_encoding", f"""WITH {CLAIM}, fit AS (SELECT * FROM cl WHERE l_orderkey % 5 > 0), pr AS (SELECT avg(target) AS p FROM fit),
  enc AS (SELECT l_suppkey, avg(target) m, count(*) n FROM fit GROUP BY 1)
  SELECT l_orderkey, l_linenumber, l_partkey, round(coalesce(p * (1 - 1 / (1 + exp(-(n - 100) / 10.0))) + m * (1 / (1 + exp(-(n - 100) / 10.0))), p), 6) AS te
  FROM cl LEFT JOIN enc USING (l_suppkey), pr WHERE l_orderkey % 5 = 0""")
def _(t):
    df = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (F.col("l_returnflag") == "R").cast("int").alias("target"))
    fit, rest = df.where("l_orderkey % 5 > 0"), df.where("l_orderkey % 5 = 0")
    table = A.target_encoding(fit, "l_suppkey", "target", "te", min_samples=100, smoothing=10)
    out = A.apply_target_encoding(rest, table, "l_suppkey", "te", fit.agg(F.avg("target")).scalar())
    return rounded(out.select("l_orderkey", "l_linenumber", "l_partkey", "te"))


@query("a22_field_value_counts", f"""WITH {CLICKS} SELECT field, value, count(*) FILTER (clicked = 1) AS pos, count(*) FILTER (clicked = 0) AS neg, count(*) AS total,
  round(count(*) FILTER (clicked = 1) / count(*), 6) AS ratio FROM (SELECT 'ad' AS field, CAST(ad AS VARCHAR) AS value, clicked FROM clicks
  UNION ALL SELECT 'k', CAST(k AS VARCHAR), clicked FROM clicks UNION ALL SELECT 'h', CAST(h AS VARCHAR), clicked FROM clicks) GROUP BY ALL HAVING count(*) >= 10""")
def _(t):
    return rounded(A.field_value_counts(clicks(t), ["ad", "k", "h"], "clicked").orderBy(F.col("total").desc(), "field", "value"))


@query("a23_class_odds", """WITH c AS (SELECT l_linenumber AS a, CAST(l_discount * 100 AS INT) AS b, l_returnflag = 'R' AS y FROM lineitem)
  SELECT a, b, n0, n1, round(odds, 6) AS odds, round(v, 6) AS odds_var FROM (SELECT a, b, count(*) FILTER (NOT y) n0, count(*) FILTER (y) n1,
    count(*) FILTER (y) / nullif(count(*) FILTER (NOT y), 0) AS odds FROM c GROUP BY ALL)
  JOIN (SELECT b, var_samp(o) v FROM (SELECT a, b, count(*) FILTER (y) / nullif(count(*) FILTER (NOT y), 0) AS o FROM c GROUP BY ALL) GROUP BY 1) USING (b)""")
def _(t):
    df = t.lineitem.select(F.col("l_linenumber").alias("a"), F.round(F.col("l_discount") * 100).cast("int").alias("b"), (F.col("l_returnflag") == "R").cast("int").alias("y"))
    odds = A.class_odds(df, "a", "b", "y")
    return rounded(odds.join(odds.groupBy("b").agg(F.var_samp("odds").alias("odds_var")), "b"))


@query("a24_column_statistics", "SELECT " + ", ".join(
    f"round(median({c}), 6) AS {c}_median, round(avg({c}), 6) AS {c}_mean, round(skewness({c}), 6) AS {c}_skew" for c in ("l_quantity", "l_extendedprice", "l_discount")) + " FROM lineitem")
def _(t):
    cols = ("l_quantity", "l_extendedprice", "l_discount")
    out = t.lineitem.agg(*[x for c in cols for x in (F.avg(c).alias(f"{c}_mean"), A.skewness_corrected(c).alias(f"{c}_skew"))])
    medians = column_quantiles(t.lineitem, cols, {"q": 0.5})
    return rounded(out.select("*", *[F.lit(medians[c]["q"]).alias(f"{c}_median") for c in cols]))


@query("a25_column_uniques", """SELECT DISTINCT * FROM (SELECT 'l_returnflag' AS c, l_returnflag AS v FROM lineitem UNION ALL SELECT 'l_linestatus', l_linestatus FROM lineitem
  UNION ALL SELECT 'l_linenumber', CAST(l_linenumber AS VARCHAR) FROM lineitem)""")
def _(t):
    cols = ["l_returnflag", "l_linestatus", "l_linenumber"]
    return t.lineitem.select([F.col(c).cast("string") for c in cols]).unpivot([], cols, "c", "v").distinct()


@query("a26_word_counts", f"SELECT word, count(*) AS n FROM (SELECT unnest({LETTER_WORDS}) AS word FROM documents) GROUP BY 1")
def _(t):
    return A.word_counts(t.documents, letter_words("text"))


@query("a27_class_balance", "SELECT toxic, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM labels GROUP BY 1")
def _(t):
    return rounded(A.share_of_total(t.labels, "toxic"))


@query("a28_log_count_ratio", f"""WITH w AS (SELECT word, toxic FROM (SELECT doc_id, unnest({WORDS}) AS word FROM documents) JOIN labels USING (doc_id)),
  c AS (SELECT word, count(*) FILTER (toxic = 1) + 1 AS p, count(*) FILTER (toxic = 0) + 1 AS q FROM w GROUP BY 1)
  SELECT word, round(ln(p / (SELECT sum(p) FROM c)) - ln(q / (SELECT sum(q) FROM c)), 6) AS ratio FROM c""")
def _(t):
    words = t.documents.join(t.labels, "doc_id").select("toxic", F.explode(ascii_words("text")).alias("word"))
    return rounded(A.log_count_ratio(words, "word", "toxic"))


@query("a29_list_moments", """SELECT doc_id, round(list_avg(l), 6) AS mean, round(list_stddev_pop(l), 6) AS std, CAST(list_min(l) AS DOUBLE) AS min, CAST(list_max(l) AS DOUBLE) AS max,
  list_median(l) AS median FROM (SELECT doc_id, list_transform(regexp_extract_all(lower(text), '[\\pL\\pN]+'), lambda x: length(x)) AS l FROM documents)""")
def _(t):
    lengths = t.documents.select("doc_id", F.transform(letter_words("text"), F.length).alias("l"))
    return rounded(lengths.select("doc_id", *[c.alias(n) for n, c in A.array_moments(F.col("l")).items()]))


@query("a30_linked_distance_stats", basket_sql("""SELECT id, class, round(avg(jaccard), 6) AS mean, round(stddev_pop(jaccard), 6) AS std, round(min(jaccard), 6) AS q0,
  round(median(jaccard), 6) AS q50, round(max(jaccard), 6) AS q100 FROM dist GROUP BY ALL""", SET_DISTANCE))
def _(t):
    d = linked_set_distance(*basket_links(t))
    # an order has at most three links, so each group is that small
    return rounded(d.groupBy("id", "class").agg(F.avg("jaccard").alias("mean"), F.stddev_pop("jaccard").alias("std"), F.min("jaccard").alias("q0"),
                                                F.median("jaccard").alias("q50"), F.max("jaccard").alias("q100")))


@query("a30_similar_set_stats", basket_sql("""SELECT id, class, count(*) AS rows, round(avg(jaccard), 6) AS mean, round(stddev_pop(jaccard), 5) AS std, round(min(jaccard), 6) AS q0,
  round(median(jaccard), 6) AS q50, round(max(jaccard), 6) AS q100 FROM alike GROUP BY ALL""", SIMILAR_SETS))
def _(t):
    asked, others, classes = order_sets(t)
    stats = class_distances(asked, others, classes, 20)
    return rounded(stats.withColumn("std", F.round("std", 5)))


@query("a31_vector_shape", """WITH e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x FROM embeddings), m AS (SELECT vec_id, avg(x) AS mu FROM e GROUP BY 1)
  SELECT vec_id, round(avg(power(x - mu, 3)) / power(avg(power(x - mu, 2)), 1.5), 5) AS skew, round(avg(power(x - mu, 4)) / power(avg(power(x - mu, 2)), 2) - 3, 5) AS kurtosis
  FROM e JOIN m USING (vec_id) GROUP BY 1""")
def _(t):
    v = t.embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    return rounded(v.select("vec_id", *[c.alias(n) for n, c in A.array_shape(F.col("v")).items()]), 5)


@query("a32_row_total", f"WITH {PANEL} SELECT user_id, w, click + error + purchase + signup + view AS total FROM pn")
def _(t):
    return weekly_panel(t).select("user_id", "w", A.row_total([F.col(c) for c in FLAGS]).alias("total"))


@query("a33_sentinels_per_row", """WITH n AS (SELECT l_orderkey, l_linenumber, l_partkey, (CASE WHEN l_tax = 0 THEN 1 ELSE 0 END) + (CASE WHEN l_discount = 0 THEN 1 ELSE 0 END)
  + (CASE WHEN l_quantity = 1 THEN 1 ELSE 0 END) AS nulls FROM lineitem) SELECT *, round((nulls - (SELECT min(nulls) FROM n)) / ((SELECT max(nulls) FROM n) - (SELECT min(nulls) FROM n)), 6) AS scaled FROM n""")
def _(t):
    li = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", *[F.coalesce(F.nullif(c, F.lit(v)), F.lit(-1.0)).alias(c) for c, v in (("l_tax", 0.0), ("l_discount", 0.0), ("l_quantity", 1.0))])
    out = li.select("l_orderkey", "l_linenumber", "l_partkey", A.row_matches([F.col(c) for c in ("l_tax", "l_discount", "l_quantity")], -1.0).alias("nulls"))
    low, high = out.agg(F.min("nulls")).scalar(), out.agg(F.max("nulls")).scalar()
    return rounded(out.withColumn("scaled", (F.col("nulls") - low) / (high - low)))


@query("a34_top_by_mean", "SELECT l_suppkey, count(*) AS n, round(avg(l_quantity), 6) AS m FROM lineitem GROUP BY 1 HAVING count(*) > 40 ORDER BY round(avg(l_quantity), 6) DESC, l_suppkey LIMIT 20")
def _(t):
    g = rounded(t.lineitem.groupBy("l_suppkey").agg(F.count("*").alias("n"), F.avg("l_quantity").alias("m")).where("n > 40"))
    return top_n(g, [F.col("m").desc(), F.col("l_suppkey")], 20)


@query("a35_histogram", "SELECT hour(ts) AS h, dayofweek(ts) + 1 AS d, event_type, count(*) AS n FROM events GROUP BY ALL")
def _(t):
    return t.events.groupBy(F.hour("ts").cast("long").alias("h"), F.dayofweek("ts").cast("long").alias("d"), "event_type").agg(F.count("*").alias("n"))


@query("a36_two_way_rates", basket_sql('SELECT department_id, count(*) FILTER (reordered = 0) AS "0", count(*) FILTER (reordered = 1) AS "1", count(*) AS total, round(avg(reordered), 6) AS reorder_rate FROM lines GROUP BY 1'))
def _(t):
    p = basket_lines(t).groupBy("department_id").pivot("reordered", [0, 1]).agg(F.count(F.lit(1))).fillna(0)
    return rounded(p.withColumn("total", F.col("0") + F.col("1")).withColumn("reorder_rate", F.col("1") / F.col("total")))


@query("a37_last_per_group", basket_sql("SELECT order_id, max(cart_pos) AS n_items, arg_max(product_id, (cart_pos, product_id)) AS last_product FROM lines GROUP BY 1"))
def _(t):
    last = F.max_by(F.col("product_id"), F.struct("cart_pos", "product_id"))
    return basket_lines(t).groupBy("order_id").agg(F.max("cart_pos").alias("n_items"), last.alias("last_product"))


@query("a38_rate_by_position", basket_sql("""SELECT cart_pos, round(avg(again / n), 6) AS reorder_rate, count(*) AS total_count FROM
  (SELECT product_id, cart_pos, count(*) n, sum(reordered) again FROM lines WHERE eval_set = 'train' GROUP BY ALL) WHERE again > 0 GROUP BY 1"""))
def _(t):
    train = basket_lines(t).where("eval_set = 'train'")
    cells = train.groupBy("product_id", "cart_pos").agg(F.count("*").alias("n"), F.sum("reordered").alias("again")).where("again > 0")
    return rounded(cells.groupBy("cart_pos").agg(F.avg(F.col("again") / F.col("n")).alias("reorder_rate"), F.count("*").alias("total_count")))


@query("a39_always_reordered", basket_sql("""SELECT user_id, count(*) FILTER (m = 1) AS n_equal, CAST(min(CASE WHEN m = 1 THEN 1 ELSE 0 END) AS BIGINT) AS every
  FROM (SELECT user_id, order_id, avg(reordered) m FROM lines WHERE order_number > 2 GROUP BY ALL) GROUP BY 1"""))
def _(t):
    per = basket_lines(t).where("order_number > 2").groupBy("user_id", "order_id").agg(F.min("reordered").alias("all_again"))
    return per.groupBy("user_id").agg(F.sum("all_again").alias("n_equal"), F.min("all_again").alias("every"))


@query("a40_category_roll_up", basket_sql("""SELECT department_id, aisle_id, 'department ' || department_id AS department, 'aisle ' || aisle_id AS aisle, n, CAST(sumcount AS BIGINT) AS sumcount
  FROM (SELECT department_id, aisle_id, count(*) n FROM prods GROUP BY ALL) JOIN (SELECT department_id, aisle_id, sum(c) AS sumcount FROM
  (SELECT product_id, count(*) c FROM lines GROUP BY 1) JOIN prods USING (product_id) GROUP BY ALL) USING (department_id, aisle_id)"""))
def _(t):
    p = products(t)
    keys = ["department_id", "aisle_id"]
    sales = basket_lines(t).groupBy("product_id").agg(F.count("*").alias("c")).join(p, "product_id").groupBy(*keys).agg(F.sum("c").alias("sumcount"))
    departments = p.select("department_id", F.concat(F.lit("department "), "department_id").alias("department")).distinct()
    aisles = p.select("aisle_id", F.concat(F.lit("aisle "), "aisle_id").alias("aisle")).distinct()
    n = p.groupBy(*keys).agg(F.count("*").alias("n"))
    return n.join(sales, keys).join(departments, "department_id").join(aisles, "aisle_id")


@query("a41_ids_by_class", """SELECT label, chunk, list(vec_id ORDER BY vec_id) AS items FROM (SELECT label, vec_id, CAST((row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1) // 20 AS BIGINT) AS chunk
  FROM embeddings) GROUP BY ALL""")
def _(t):
    return number_chunks(t.embeddings, ["label"], "vec_id", size=20)
