"""Sampling, models, metrics, blends and output shaping."""

from pyspark.ml.feature import HashingTF
from pyspark.sql import functions as F

from tessera.catalog.base import query
from tessera.catalog.encoder_queries import listings
from tessera.catalog.panel import FLAGS
from tessera.catalog.views import basket_lines, basket_orders, basket_sql
from tessera.catalog.window_queries import PRED, predictions
from tessera.functions import text as X
from tessera.operators import bags as G
from tessera.operators import blends as L
from tessera.operators import encoders as E
from tessera.operators import metrics as Q
from tessera.operators import models as M
from tessera.operators import sampling as S
from tessera.operators.expected_f1 import best_baskets
from tessera.operators.frames import rounded
from tessera.operators.topk import joined_ids, with_fallback_rows
from tessera.plans import matrices
from tessera.session import cut_lineage

LINE = "l_orderkey, l_linenumber, l_partkey"
IDS = ["l_orderkey", "l_linenumber", "l_partkey"]


def md5_sql(x, n):
    return f"('0x' || substr(md5({x}), 1, 15))::BIGINT % {n}"


@query("m01_random_hold_out", f"SELECT event_id, {md5_sql('event_id::VARCHAR', 100)} < 20 AS held FROM events")
def _(t):
    train, valid = S.hold_out(t.events, F.col("event_id"), 20)
    return train.select("event_id", F.lit(False).alias("held")).unionByName(valid.select("event_id", F.lit(True).alias("held")))


@query("m02_group_hold_out", f"SELECT o_orderkey FROM orders WHERE {md5_sql('o_custkey::VARCHAR', 100)} < 10")
def _(t):
    return S.hold_out(t.orders, F.col("o_custkey"), 10)[1].select("o_orderkey")


@query("m03_time_hold_out", """SELECT left_out, CASE WHEN month(l_shipdate) = left_out THEN 'valid' ELSE 'train' END AS part, count(*) AS n, round(sum(l_quantity), 2) AS q
  FROM lineitem, (SELECT unnest([10, 11, 12]) AS left_out) GROUP BY ALL""")
def _(t):
    df = t.lineitem.select(F.month("l_shipdate").alias("m"), "l_quantity")
    return S.hold_out_times(df, "m", [10, 11, 12]).groupBy("left_out", "part").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("q"))


@query("m04_folds", f"SELECT event_id, {md5_sql('event_id::VARCHAR', 5)} AS fold FROM events")
def _(t):
    return S.folds(t.events, F.col("event_id"), 5).select("event_id", "fold")


@query("m05_stratified_folds", f"SELECT event_id, (row_number() OVER (PARTITION BY event_type ORDER BY {md5_sql('event_id::VARCHAR', 1 << 60)}, event_id) - 1) % 5 AS fold FROM events")
def _(t):
    return S.stratified_folds(t.events, "event_id", "event_type", 5).select("event_id", "fold")


def purchases(t):
    return t.events.select("event_id", (F.col("event_type") == "click").cast("int").alias("y"))


@query("m06_oversampled", """WITH e AS (SELECT event_id, CAST(event_type = 'click' AS INT) AS y FROM events), s AS (SELECT avg(y) / 0.06 - 1 AS s0 FROM e), k AS (SELECT CAST(2 ** greatest(ceil(s0) - 1, 0) AS INT) AS copies, s0 - greatest(ceil(s0) - 1, 0) AS part FROM s),
  z AS (SELECT event_id, c, row_number() OVER (ORDER BY c, event_id) AS r FROM e, (SELECT unnest(range(1, 1 + (SELECT copies FROM k))) AS c) WHERE y = 0),
  a AS (SELECT event_id, 1 AS y FROM e WHERE y = 1 UNION ALL SELECT event_id, 0 FROM z UNION ALL SELECT event_id, 0 FROM z, k WHERE r <= floor(part * (SELECT count(*) FROM z)))
  SELECT event_id, y, count(*) AS n FROM a GROUP BY ALL""")
def _(t):
    return S.oversample(purchases(t), "event_id", "y", 0.06).groupBy("event_id", "y").agg(F.count("*").alias("n"))


@query("m07_up_down_sampled", """WITH e AS (SELECT event_id, CAST(event_type = 'click' AS INT) AS y FROM events), o AS (SELECT event_id, row_number() OVER (ORDER BY event_id) r FROM e WHERE y = 1)
  SELECT event_id, 0 AS y, 2 AS n FROM e WHERE y = 0 UNION ALL SELECT event_id, 1, 1 FROM o WHERE r <= floor(0.8 * (SELECT count(*) FROM o))""")
def _(t):
    return S.up_down_sample(purchases(t), "event_id", "y").groupBy("event_id", "y").agg(F.count("*").cast("int").alias("n"))


@query("m08_bootstrap", f"""WITH b AS (SELECT o_custkey AS bag, row_number() OVER (ORDER BY o_custkey) AS slot FROM (SELECT DISTINCT o_custkey FROM orders)), n AS (SELECT count(*) AS n FROM b)
  SELECT draw, s.slot, b.bag FROM (SELECT draw, slot, {md5_sql("draw || '-' || slot", 'n')} + 1 AS at FROM b, n, (SELECT CAST(unnest(range(1, 51)) AS INT) AS draw)) s JOIN b ON b.slot = s.at""")
def _(t):
    return S.bootstrap(t.orders.select(F.col("o_custkey").alias("bag")), "bag", 50)


TAKEN = " + ".join(f"(u >= {c})::INT" for c in S.poisson_cuts())


@query("m08_poisson_bootstrap", f"""WITH u AS (SELECT draw, l_quantity::DOUBLE AS x, {md5_sql("draw || '-' || l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey", 1 << 32)} AS u
    FROM lineitem, (SELECT unnest(range(1, 51)) AS draw)), w AS (SELECT draw, x, {TAKEN} AS t FROM u)
  SELECT CAST(draw AS INT) AS draw, CAST(sum(t) AS BIGINT) AS rows, round(sum(x * t) / sum(t), 6) AS mean FROM w GROUP BY 1""")
def _(t):
    lines = t.lineitem.withColumn("x", F.col("l_quantity").cast("double"))
    return rounded(S.poisson_means(lines, F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), "x", 50))


BAGS = """bg AS (SELECT l_orderkey AS bag, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS instance, l_quantity / 50 AS a, l_extendedprice / 100000 AS b, l_discount * 10 AS c FROM lineitem)"""


def bags(t):
    """Order lines as instances, orders as bags, y = order value."""
    from tessera.operators.ranges import split_window
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
    inst = split_window(t.lineitem.select("l_orderkey", "l_discount", *order), ["l_orderkey"], order, row_number="instance")
    y = t.orders.select(F.col("o_orderkey").alias("bag"), (F.col("o_totalprice") / 100000).alias("y"))
    return inst.select(F.col("l_orderkey").alias("bag"), "instance", (F.col("l_quantity") / 50).alias("a"), (F.col("l_extendedprice") / 100000).alias("b"),
                       (F.col("l_discount") * 10).alias("c")).join(y, "bag")


FEATURES = ["a", "b", "c"]


@query("m09_equal_bags", f"""WITH {BAGS}, h AS (SELECT bag, instance, row_number() OVER (PARTITION BY bag ORDER BY {md5_sql("bag || '-' || instance", 1 << 60)}, instance) AS r, count(*) OVER (PARTITION BY bag) AS n FROM bg)
  SELECT bag, instance, s AS slot FROM h, (SELECT unnest(range(1, 6)) AS s) WHERE (s - 1) % n = r - 1""")
def _(t):
    return S.equal_bags(bags(t), "bag", "instance", 5).select("bag", "instance", "slot")


@query("m10_least_squares", "SELECT l_suppkey, round(regr_slope(l_extendedprice, l_quantity), 6) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 6) AS shift FROM lineitem GROUP BY 1")
def _(t):
    y, x = F.col("l_extendedprice"), F.col("l_quantity")
    return rounded(t.lineitem.groupBy("l_suppkey").agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("shift")))


def listing_features(t):
    df = matrices.hashed_listings(matrices.prepared_listings(listings(t)))
    return df.select(F.col("p_partkey").alias("id"), "features", F.col("price").alias("label"))


def held(df):
    """Three quarters of the rows by a hash of their id to fit on, the others to score."""
    part = E.hash_bucket(F.col("id"), 4)
    return df.where(part > 0), df.where(part == 0)


@query("m11_ridge_on_text")
def _(t):
    train, test = held(listing_features(t))
    return M.scored(M.ridge(0.1).fit(train), test, "p").select("id", "label", "p")


NUM = ["l_quantity", "l_discount", "l_tax", "l_linenumber"]


def claims(t):
    key = F.concat_ws("-", *IDS, "l_suppkey", "l_quantity", "l_extendedprice")
    return t.lineitem.select(key.alias("id"), *NUM, "l_extendedprice", (F.col("l_returnflag") == "R").cast("double").alias("label"))


def prices(t):
    return M.assembled(claims(t).withColumn("label", F.col("l_extendedprice") / 10000), NUM)


@query("m12_elastic_net")
def _(t):
    train, test = held(prices(t))
    return M.scored(M.elastic_net(0.01, 0.9).fit(train), test, "p").agg(*[c.alias(n) for n, c in Q.regression_metrics("label", "p").items()])


def comments(t):
    words = t.documents.join(t.labels, "doc_id").select(F.col("doc_id").alias("id"), "toxic", "quality", X.regex_words("text").alias("w"))
    return HashingTF(inputCol="w", outputCol="features", numFeatures=4096).transform(words).drop("w")


@query("m13_logistic_per_label")
def _(t):
    return M.per_label(comments(t), ["toxic", "quality"], lambda c: M.logistic(0.01, label=c), "id")


@query("m14_out_of_fold_logistic")
def _(t):
    df = S.stratified_folds(comments(t), "id", "quality", 3).withColumn("label", F.col("quality").cast("double"))
    return M.out_of_fold(df, M.logistic(0.001, 0.2, iterations=15), "fold", 3, "p")[0].select("id", "fold", "p")


def hashed_clicks(t):
    from pyspark.ml.feature import FeatureHasher
    df = t.events.select(F.col("event_id").alias("id"), "ts", F.col("user_id").cast("string").alias("ad"), F.get_json_object("props", "$.k").alias("k"),
                         F.hour("ts").cast("string").alias("h"), (F.col("event_type") == "click").cast("double").alias("label"))
    df = df.withColumn("ad_h", F.concat_ws("_", "ad", "h"))
    return FeatureHasher(inputCols=["ad", "k", "h", "ad_h"], outputCol="features", numFeatures=1 << 16).transform(df)


@query("m15_hashed_logistic")
def _(t):
    train, test = held(hashed_clicks(t))
    return M.scored(M.logistic(0.01, 0.1, iterations=10).fit(train), test, "p").select("id", "p")


@query("m16_factorization_machine")
def _(t):
    train, test = held(listing_features(t))
    return M.scored(M.factorization_machine(iterations=10).fit(train), test, "p").select("id", "label", "p")


@query("m17_boosted_trees")
def _(t):
    train, test = held(M.assembled(claims(t), [*NUM, "l_extendedprice"]))
    one = M.scored(M.boosted_classifier(trees=5, depth=3).fit(train), test, "p")
    reg, asked = held(prices(t))
    two = M.scored(M.boosted_regressor(trees=5, depth=3).fit(reg), asked, "price")
    return one.agg(Q.logloss("label", "p").alias("logloss")).withColumn("rmse", two.agg(Q.regression_metrics("label", "price")["rmse"]).scalar())


@query("m18_next_product_classes")
def _(t):
    from tessera.catalog.scalar_queries import vectors
    from tessera.plans.panel import new_product_rows
    states = [f"{p}_{k}" for p in FLAGS for k in (1, 2)]
    v = vectors(t)
    rows = M.assembled(new_product_rows(v, FLAGS).withColumn("label", F.col("label").cast("double")), [*states, "age_scaled", "income_scaled"])
    model = M.forest_classifier(trees=5, depth=3).fit(rows)
    from pyspark.ml.functions import vector_to_array
    return model.transform(M.assembled(v, [*states, "age_scaled", "income_scaled"])).select("ncodpers", vector_to_array("probability").alias("p"))


@query("m19_forests")
def _(t):
    train, test = held(M.assembled(claims(t), [*NUM, "l_extendedprice"]))
    a = M.scored(M.forest_classifier(trees=5, depth=4).fit(train), test, "forest").select("id", "label", "forest")
    b = M.scored(M.forest_classifier(trees=5, depth=4, random_cuts=True).fit(train), test, "extra").select("id", "extra")
    return a.join(b, "id").agg(Q.logloss("label", "forest").alias("forest"), Q.logloss("label", "extra").alias("extra"))


@query("m20_naive_bayes")
def _(t):
    train, test = held(comments(t).withColumn("label", F.col("quality").cast("double")))
    return M.scored(M.naive_bayes().fit(train), test, "p").select("id", "p")


@query("m21_perceptron")
def _(t):
    from pyspark.ml.functions import array_to_vector
    df = t.embeddings.select(F.col("vec_id").alias("id"), array_to_vector(F.col("embedding").cast("array<double>")).alias("features"), F.col("label").cast("double").alias("label"))
    out = M.perceptron([64, 16, 10]).fit(df).transform(df)
    return out.select("id", "label", "prediction")


@query("m22_grid_search")
def _(t):
    return M.grid_search(prices(t), M.elastic_net(0.1, 0.5), {"regParam": [0.01, 0.1], "elasticNetParam": [0.1, 0.9]}, folds=3)


@query("m23_stacking")
def _(t):
    df = S.folds(claims(t), F.col("id"), 4).withColumn("label", F.col("l_extendedprice") / 10000)
    train = S.folds(df.where("fold < 3").drop("fold"), F.concat(F.lit("f"), "id"), 3)
    test = df.where("fold = 3").drop("fold")
    out, applied = M.stacked(train, test, NUM, {"ridge": M.ridge(0.1), "forest": M.forest_regressor(trees=5, depth=4)}, M.elastic_net(0.001, 0.1), "fold", 3)
    return out.select("id", F.lit("train").alias("part"), "stacked").unionByName(applied.select("id", F.lit("test").alias("part"), "stacked"))


@query("m24_log_target")
def _(t):
    train, test = held(prices(t))
    return M.log_target(M.ridge(0.01), "label").fit(train).transform(test).agg(*[c.alias(n) for n, c in Q.regression_metrics("label", "predicted").items()])


@query("m25_cluster_regression")
def _(t):
    return G.cluster_regression(bags(t), FEATURES)


@query("m26_pruned_bags")
def _(t):
    return G.pruned_regression(bags(t), FEATURES, size=6, rate=0.2)


@query("m27_instance_weights")
def _(t):
    return G.instance_weighted_regression(bags(t), FEATURES, epochs=3)


METRIC = f"WITH {PRED}"


def one_row(t, **cols):
    return rounded(predictions(t).agg(*[c.alias(n) for n, c in cols.items()]))


@query("m28_rmsle", f"{METRIC} SELECT round(sqrt(avg((ln(1 + y) - ln(1 + p1)) ** 2)), 6) AS rmsle FROM pr")
def _(t):
    return one_row(t, rmsle=Q.regression_metrics("y", "p1")["rmsle"])


@query("m29_regression_metrics", f"{METRIC} SELECT round(avg((y - p1) ** 2), 6) AS mse, round(sqrt(avg((y - p1) ** 2)), 6) AS rmse, round(avg(abs(y - p1)), 6) AS mae, round(1 - avg((y - p1) ** 2) / var_pop(y), 6) AS r2 FROM pr")
def _(t):
    m = Q.regression_metrics("y", "p1")
    return one_row(t, **{k: m[k] for k in ("mse", "rmse", "mae", "r2")})


@query("m30_logloss", f"{METRIC} SELECT round(avg(CASE WHEN y = 1 THEN -ln(p1) ELSE -ln(1 - p1) END), 6) AS logloss FROM pr")
def _(t):
    return one_row(t, logloss=Q.logloss("y", "p1"))


GINI = """g AS (SELECT (sum(c) / sum(y) - (count(*) + 1) / 2) / count(*) AS gini, 1 - 2 * sum(y * zz) / (sum(y) * (count(*) - sum(y))) AS paired FROM
    (SELECT y, sum(y) OVER w AS c, sum(1 - y) OVER w AS zz FROM pr WINDOW w AS (ORDER BY p1 DESC, u ROWS UNBOUNDED PRECEDING))),
  h AS (SELECT (sum(c) / sum(y) - (count(*) + 1) / 2) / count(*) AS perfect FROM (SELECT y, sum(y) OVER (ORDER BY y DESC, u ROWS UNBOUNDED PRECEDING) c FROM pr))"""
PRED_U = PRED.replace("AS id FROM", "AS id, l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || l_quantity || '-' || l_extendedprice AS u FROM")


@query("m31_normalised_gini", f"WITH {PRED_U}, {GINI} SELECT round(gini, 6) AS gini, round(perfect, 6) AS gini_perfect, round(gini / perfect, 6) AS gini_normalised, round(paired, 6) AS paired FROM g, h")
def _(t):
    df = t.lineitem.select(F.concat_ws("-", *IDS, "l_suppkey", "l_quantity", "l_extendedprice").alias("u"), (F.col("l_returnflag") == "R").cast("int").alias("y"),
                           F.round(0.1 + 0.8 * F.col("l_quantity") / 50, 6).alias("p1"))
    # written once: cut points and both orders read the names made of six columns
    df = cut_lineage(df)
    return rounded(Q.gini(df, "y", "p1", "u").withColumn("paired", Q.gini_pairwise(df, "y", "p1", "u").scalar()))


@query("m32_roc_auc", f"{METRIC}, r AS (SELECT y, rank() OVER (ORDER BY p1) + (count(*) OVER (PARTITION BY p1) - 1) / 2 AS r FROM pr) SELECT round((sum(r * y) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * (count(*) - sum(y))), 6) AS auc FROM r")
def _(t):
    return rounded(Q.roc_auc(predictions(t), "y", "p1"))


CUTS = [0.2, 0.4, 0.6, 0.8]


@query("m33_f_score_by_threshold", f"""{METRIC}, g AS (SELECT l_orderkey, c, count(*) FILTER (y = 1 AND p1 > c) AS tp, count(*) FILTER (y = 0 AND p1 > c) AS fp, count(*) FILTER (y = 1 AND p1 <= c) AS fn FROM pr, (SELECT unnest({CUTS})::DOUBLE AS c) GROUP BY ALL)
  SELECT c AS threshold, round(avg(CASE WHEN 2 * tp + fp + fn = 0 THEN 1.0 ELSE 2 * tp / (2 * tp + fp + fn) END), 6) AS score FROM g GROUP BY 1""")
def _(t):
    return rounded(Q.f_beta_per_group(predictions(t), "l_orderkey", "y", "p1", CUTS))


@query("m34_accuracy", f"{METRIC} SELECT round(avg(CASE WHEN y = CAST(p1 > 0.5 AS INT) THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM pr")
def _(t):
    df = predictions(t).withColumn("c", (F.col("p1") > 0.5).cast("int"))
    return rounded(df.agg(Q.accuracy("y", "c").alias("accuracy")))


def basket_predictions(t):
    p = F.round(((F.col("product_id") * 37 + F.col("user_id") * 11) % 97) / 100, 4)
    orders = basket_orders(t)
    bought = basket_lines(t, orders).where("eval_set = 'prior'").select("user_id", "product_id").distinct()
    return orders.where("eval_set = 'test'").select("order_id", "user_id").join(bought, "user_id").withColumn("prediction", p)


@query("m35_expected_f1_baskets")
def _(t):
    return best_baskets(basket_predictions(t))


@query("m36_correlations", f"""{METRIC}, c AS (SELECT p2 AS a, p3 AS b, count(*) AS w FROM pr GROUP BY ALL), r AS (SELECT p1, p2, rank() OVER (ORDER BY p1) + (count(*) OVER (PARTITION BY p1) - 1) / 2 AS r1, rank() OVER (ORDER BY p2) + (count(*) OVER (PARTITION BY p2) - 1) / 2 AS r2 FROM pr),
  k AS (SELECT sum(x.w * y.w * sign((x.a - y.a) * (y.b - x.b)) * -1) / 2 AS s FROM c x, c y), n AS (SELECT sum(w) * (sum(w) - 1) / 2 AS n0 FROM c), na AS (SELECT sum(t * (t - 1) / 2) AS n1 FROM (SELECT sum(w) t FROM c GROUP BY a)), nb AS (SELECT sum(t * (t - 1) / 2) AS n2 FROM (SELECT sum(w) t FROM c GROUP BY b)),
  v AS (SELECT v, sum(x) AS x, sum(y) AS y FROM (SELECT p1 AS v, 1 AS x, 0 AS y FROM pr UNION ALL SELECT p2, 0, 1 FROM pr) GROUP BY 1), ks AS (SELECT max(abs(cx - cy)) AS ks FROM (SELECT sum(x) OVER (ORDER BY v) AS cx, sum(y) OVER (ORDER BY v) AS cy FROM v))
  SELECT (SELECT round(corr(p1, p2), 6) + 0.0 FROM pr) AS pearson, (SELECT round(corr(r1, r2), 6) + 0.0 FROM r) AS spearman, round(s / sqrt((n0 - n1) * (n0 - n2)), 6) + 0.0 AS kendall, round(ks / (SELECT count(*) FROM pr), 6) AS ks FROM k, n, na, nb, ks""")
def _(t):
    df = predictions(t)
    row = df.agg(F.corr("p1", "p2").alias("pearson"))
    return rounded(row.withColumn("spearman", Q.spearman(df, "p1", "p2")).withColumn("kendall", Q.kendall_tau_b(df, "p2", "p3")).withColumn("ks", Q.kolmogorov_smirnov(df, "p1", "p2")))


P3 = ["p1", "p2", "p3"]


@query("m37_weighted_mean", f"{METRIC} SELECT {LINE}, round((p1 + p2 + p3) / 3, 6) AS u, round(p1 * 0.2 + p2 * 0.3 + p3 * 0.5, 6) AS w FROM pr")
def _(t):
    c = [F.col(x) for x in P3]
    return rounded(predictions(t).select(*IDS, L.weighted_mean(c).alias("u"), L.weighted_mean(c, [0.2, 0.3, 0.5]).alias("w")))


@query("m38_row_median", f"{METRIC} SELECT {LINE}, list_median([p1, p2, p3]) AS m FROM pr")
def _(t):
    return predictions(t).select(*IDS, L.row_median([F.col(x) for x in P3]).alias("m"))


@query("m39_log_mean", f"{METRIC} SELECT {LINE}, round(exp((2 * ln(p1) + ln(p2) + ln(p3)) / 4), 6) AS g, round(sqrt(p1 * p2), 6) AS s FROM pr")
def _(t):
    c = [F.col(x) for x in P3]
    return rounded(predictions(t).select(*IDS, L.log_mean(c, [2, 1, 1]).alias("g"), L.log_mean(c[:2]).alias("s")))


def rank_sql(c):
    return f"(rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2) / count(*) OVER ()"


@query("m40_rank_mean", f"{METRIC} SELECT id, round(({rank_sql('p1')} + {rank_sql('p2')}) / 2, 8) AS r FROM pr")
def _(t):
    return rounded(L.rank_mean(predictions(t), "id", ["p1", "p2"], "r"), 8)


def vote_tables(t):
    df = t.orders.select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 3).alias("x"), (F.col("o_orderkey") % 3).alias("y"), (F.col("o_totalprice") > 250000).cast("long").alias("z"))
    return {n: df.select("id", F.col(c).alias("label")) for n, c in (("model_a_w3_x.csv", "x"), ("model_b_w2_x.csv", "y"), ("model_c.csv", "z"))}


@query("m41_majority_vote", """WITH v AS (SELECT o_orderkey AS id, o_custkey % 3 AS label, 3 AS w FROM orders UNION ALL SELECT o_orderkey, o_orderkey % 3, 2 FROM orders UNION ALL SELECT o_orderkey, CAST(o_totalprice > 250000 AS BIGINT), 1 FROM orders)
  SELECT id, label FROM (SELECT id, label, row_number() OVER (PARTITION BY id ORDER BY sum(w) DESC, label) r FROM v GROUP BY id, label) WHERE r = 1""")
def _(t):
    return L.majority_vote(vote_tables(t), "id", "label")


@query("m42_mean_by_id", "SELECT o_orderkey AS id, round((o_custkey % 3 + o_orderkey % 3 + CAST(o_totalprice > 250000 AS INT)) / 3, 6) AS label FROM orders")
def _(t):
    return rounded(L.mean_by_id([d for d in vote_tables(t).values()], "id", "label"))


@query("m43_blend_grid", f"""{METRIC}, m AS (SELECT avg((p1 - p3) ** 2) a, avg((p2 - p3) ** 2) b, avg((p1 - p3) * (p2 - p3)) c, avg((p1 - p3) * (y - p3)) d, avg((p2 - p3) * (y - p3)) f, avg((y - p3) ** 2) g FROM pr),
  w AS (SELECT i / 100 AS w1, j / 100 AS w2 FROM (SELECT unnest(range(0, 100)) i), (SELECT unnest(range(0, 100)) j) WHERE i + j < 100),
  e AS (SELECT w1, w2, round(sqrt(w1 * w1 * a + w2 * w2 * b + 2 * w1 * w2 * c - 2 * w1 * d - 2 * w2 * f + g), 6) AS rmse FROM w, m) SELECT w1, w2, rmse FROM e ORDER BY rmse, w1, w2 LIMIT 1""")
def _(t):
    return rounded(L.best_weights(predictions(t), "y", "p1", "p2", "p3"))


@query("m44_category_blend", """SELECT p_partkey, round(a * w + b * (1 - w), 6) AS p FROM (SELECT p_partkey, ln(1 + p_retailprice) AS a, ln(1 + p_retailprice) * 0.9 + 0.5 AS b,
  CASE p_type WHEN 'PROMO' THEN 0.55 WHEN 'ECONOMY' THEN 0.65 WHEN 'SMALL' THEN 0.5 ELSE 0.6 END::DOUBLE AS w FROM part)""")
def _(t):
    kind = F.when(F.col("p_type") == "PROMO", "Home").when(F.col("p_type") == "ECONOMY", "Men").when(F.col("p_type") == "SMALL", "Other").otherwise("Unlisted")
    a = F.log1p("p_retailprice")
    return rounded(t.part.select("p_partkey", L.category_blend(kind, a, a * 0.9 + 0.5).alias("p")))


BP = """bp AS (SELECT o.order_id, o.user_id, product_id, round(((product_id * 37 + user_id * 11) % 97) / 100, 4) AS prediction FROM ord o JOIN (SELECT DISTINCT user_id, product_id FROM lines WHERE eval_set = 'prior') USING (user_id) WHERE eval_set = 'test')"""


@query("m45_threshold_decision", basket_sql("""SELECT order_id, product_id, CAST(prediction > 0.21 AS INT) AS fixed, CAST(prediction >= 0.7 * r AS INT) AS by_user FROM bp JOIN
  (SELECT user_id, sum(reordered) / nullif(count(*) FILTER (order_number > 1), 0) AS r FROM prior GROUP BY 1) USING (user_id)""", BP))
def _(t):
    prior = basket_lines(t).where("eval_set = 'prior'")
    rates = prior.groupBy("user_id").agg(F.try_divide(F.sum("reordered"), F.count_if(F.col("order_number") > 1)).alias("r"))
    p = basket_predictions(t).join(rates, "user_id")
    return p.select("order_id", "product_id", (F.col("prediction") > 0.21).cast("int").alias("fixed"), (F.col("prediction") >= 0.7 * F.col("r")).cast("int").alias("by_user"))


@query("m46_submission", basket_sql("""SELECT order_id, coalesce(string_agg(CAST(product_id AS VARCHAR), ' ' ORDER BY product_id) FILTER (prediction > 0.6), 'None') AS products FROM bp GROUP BY 1 ORDER BY 1""", BP))
def _(t):
    p = basket_predictions(t)
    chosen = joined_ids(p.where("prediction > 0.6"), ["order_id"], "product_id", "products")
    return with_fallback_rows(chosen, p, "order_id", "products").orderBy("order_id")


@query("m47_importances")
def _(t):
    cols = [*NUM, "l_extendedprice"]
    df = M.assembled(claims(t), cols)
    return M.importances(M.boosted_classifier(trees=3, depth=3).fit(df), cols, df)


def uniform_sql(draw):
    return f"(({md5_sql(f"'7-{draw}-' || id", 1 << 60)}) + 0.5) / {1 << 60}::DOUBLE"


@query("m48_noisy_column", f"WITH {PRED} SELECT id, round(p1 * (1 + 0.01 * sqrt(-2 * ln({uniform_sql(1)})) * cos(2 * pi() * {uniform_sql(2)})), 6) AS p1 FROM pr")
def _(t):
    return rounded(S.with_noise(predictions(t).select("id", "p1"), F.col("id").cast("string"), "p1", 0.01, 7))


CLICK_DAYS = """ck AS (SELECT event_id AS id, date_diff('day', TIMESTAMP '2024-01-01', ts) // 7 AS block, CAST(event_type = 'click' AS BIGINT) AS label,
    coalesce(json_extract_string(props, '$.k'), '') AS k, CAST(hour(ts) AS VARCHAR) AS h, CAST(user_id AS VARCHAR) AS ad FROM events),
  lg AS (SELECT id, block, label, unnest([{'f': 'k', 'v': k}, {'f': 'h', 'v': h}, {'f': 'ad', 'v': ad}]) AS x FROM ck),
  vc AS (SELECT x, block, sum(label) AS p, count(*) - sum(label) AS q FROM lg GROUP BY ALL),
  st AS (SELECT x, block, coalesce(sum(p) OVER w, 0) AS vp, coalesce(sum(q) OVER w, 0) AS vq FROM vc WINDOW w AS (PARTITION BY x ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  tt AS (SELECT block, coalesce(sum(p) OVER w, 0) AS tp, coalesce(sum(q) OVER w, 0) AS tq FROM (SELECT block, sum(label) AS p, count(*) - sum(label) AS q FROM ck GROUP BY 1)
    WINDOW w AS (ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  sc AS (SELECT id, block, label, 1 / (1 + exp(-(ln((tp + 1) / (tq + 1)) + sum(ln(((vp + 1) / (tp + 2)) / ((vq + 1) / (tq + 2))))))) AS p
    FROM lg JOIN st USING (x, block) JOIN tt USING (block) GROUP BY id, block, label, tp, tq)"""


def scored_weeks(t):
    from tessera.operators.progressive import progressive_bayes
    rows = t.events.select(
        F.col("event_id").alias("id"), F.floor(F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")) / 7).cast("long").alias("block"),
        (F.col("event_type") == "click").cast("long").alias("label"), F.coalesce(F.get_json_object("props", "$.k"), F.lit("")).alias("k"),
        F.hour("ts").cast("string").alias("h"), F.col("user_id").cast("string").alias("ad"))
    return progressive_bayes(rows, "id", "block", "label", ["k", "h", "ad"])


@query("m49_progressive_scores", f"WITH {CLICK_DAYS} SELECT id, CAST(block AS BIGINT) AS block, round(p, 6) AS p FROM sc")
def _(t):
    return rounded(scored_weeks(t).select("id", "block", "p"))


@query("m49_progressive_validation", f"""WITH {CLICK_DAYS} SELECT CAST(block AS BIGINT) AS block, count(*) AS n,
  round(-avg(label * ln(greatest(least(p, 1 - 1e-15), 1e-15)) + (1 - label) * ln(1 - greatest(least(p, 1 - 1e-15), 1e-15))), 5) AS logloss FROM sc GROUP BY 1""")
def _(t):
    """Logloss of each week, scored by the weeks before it."""
    scored = scored_weeks(t)
    return rounded(scored.groupBy("block").agg(F.count("*").alias("n"), Q.logloss("label", "p").alias("logloss")), 5)
