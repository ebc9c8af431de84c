"""Scalar functions (C1-C24) and the panel tables."""

from pyspark.sql import functions as F

from tessera.catalog.aggregate_queries import CLAIM, DEMAND, demand
from tessera.catalog.base import query
from tessera.catalog.panel import FLAGS, PANEL, weekly_panel
from tessera.catalog.window_queries import PRED, predictions
from tessera.functions import scalars as C
from tessera.operators import fills as L
from tessera.operators.frames import rounded
from tessera.plans import panel as P

LINE = "l_orderkey, l_linenumber, l_partkey"
IDS = ["l_orderkey", "l_linenumber", "l_partkey"]


def line(t, *cols):
    return t.lineitem.select(*IDS, *cols)


def line_sql(*cols):
    return f"SELECT {LINE}, {', '.join(cols)} FROM lineitem"


@query("c01_guarded_divide", line_sql("round(coalesce(l_quantity / nullif(l_discount, 0), 0), 6) AS r"))
def _(t):
    return rounded(line(t, C.safe_ratio("l_quantity", "l_discount").alias("r")))


MEANS = """pca AS (SELECT product, client, agency, avg(ln(1 + demand)) a FROM dm WHERE week <> 12 GROUP BY ALL),
  pr AS (SELECT product, route, avg(ln(1 + demand)) b FROM dm WHERE week <> 12 GROUP BY ALL), p AS (SELECT product, avg(ln(1 + demand)) c FROM dm WHERE week <> 12 GROUP BY 1),
  o AS (SELECT avg(ln(1 + demand)) d FROM dm WHERE week <> 12)"""


@query("c02_fallback_chain", f"""WITH {DEMAND}, {MEANS} SELECT client, product, agency, route, demand,
  round(coalesce((exp(a) - 1) * 1.1 + 0.2, (exp(b) - 1) * 1.0 + 0.1, (exp(c) - 1) * 0.9, exp(d) - 1), 6) AS pred
  FROM dm LEFT JOIN pca USING (product, client, agency) LEFT JOIN pr USING (product, route) LEFT JOIN p USING (product), o WHERE week = 12""")
def _(t):
    df = demand(t).withColumn("y", F.log1p("demand"))
    fit, test = df.where("week <> 12"), df.where("week = 12")
    m = lambda keys, name: fit.groupBy(*keys).agg(F.avg("y").alias(name))
    out = test.join(m(["product", "client", "agency"], "a"), ["product", "client", "agency"], "left").join(
        m(["product", "route"], "b"), ["product", "route"], "left").join(m(["product"], "c"), "product", "left")
    chain = C.fallback_chain([(F.col("a"), 1.1, 0.2), (F.col("b"), 1.0, 0.1), (F.col("c"), 0.9, 0.0), (fit.agg(F.avg("y")).scalar(), 1.0, 0.0)])
    return rounded(out.select("client", "product", "agency", "route", "demand", chain.alias("pred")))


@query("c03_log_target", line_sql("round(ln(1 + l_extendedprice), 6) AS lg", "round(exp(ln(1 + l_quantity)) - 1, 6) AS back"))
def _(t):
    return rounded(line(t, F.log1p("l_extendedprice").alias("lg"), F.expm1(F.log1p("l_quantity")).alias("back")))


@query("c04_clip_and_scale", "SELECT c_custkey, round((least(greatest(coalesce(nullif(c_acctbal, 0), 500.0), 0.0), 5000.0) - 0.0) / 5000.0, 4) AS s FROM customer")
def _(t):
    return t.customer.select("c_custkey", C.clip_scale(F.nullif("c_acctbal", F.lit(0.0)), 0.0, 5000.0, 500.0).alias("s"))


@query("c05_range_codes", """SELECT c_custkey, CASE WHEN a BETWEEN 0 AND 19 THEN 0 WHEN a BETWEEN 20 AND 40 THEN 1 WHEN a BETWEEN 41 AND 55 THEN 2 WHEN a BETWEEN 56 AND 100 THEN 3 ELSE 4 END AS age_group,
  CASE WHEN s BETWEEN 0 AND 50 THEN 0 WHEN s BETWEEN 51 AND 100 THEN 1 WHEN s BETWEEN 101 AND 150 THEN 2 WHEN s BETWEEN 151 AND 200 THEN 3 WHEN s BETWEEN 202 AND 256 THEN 4 ELSE 5 END AS seniority_group
  FROM (SELECT c_custkey, least(greatest(coalesce(nullif(c_custkey % 110, 7), 40), 0), 100) a, least(greatest(c_custkey % 300, 0), 256) s FROM customer)""")
def _(t):
    age = F.nullif(F.col("c_custkey") % 110, F.lit(7)).cast("double")
    return t.customer.select("c_custkey", C.age_group(age).alias("age_group"), C.seniority_group((F.col("c_custkey") % 300).cast("double")).alias("seniority_group"))


@query("c06_cross_codes", """SELECT o_orderkey, CASE (CASE WHEN o_custkey % 3 = 0 THEN 'H' WHEN o_custkey % 3 = 1 THEN 'V' ELSE 'N' END) || (CASE o_orderstatus WHEN 'P' THEN '1' WHEN 'F' THEN '0' ELSE 'N' END)
  WHEN 'H1' THEN 0 WHEN 'H0' THEN 1 WHEN 'HN' THEN 2 WHEN 'V1' THEN 3 WHEN 'V0' THEN 4 WHEN 'VN' THEN 5 WHEN 'N1' THEN 6 WHEN 'N0' THEN 7 ELSE 8 END AS code FROM orders""")
def _(t):
    sex = F.when(F.col("o_custkey") % 3 == 0, "H").when(F.col("o_custkey") % 3 == 1, "V").otherwise("N")
    act = F.when(F.col("o_orderstatus") == "P", "1").when(F.col("o_orderstatus") == "F", "0").otherwise("N")
    return t.orders.select("o_orderkey", C.pair_code(F.concat(sex, act), C.SEX_ACTIVITY).alias("code"))


@query("c07_rule_index", """SELECT c_custkey, CASE WHEN c_custkey % 60 <= 28 - CASE WHEN c_nationkey % 2 = 0 THEN 2 ELSE 0 END - CASE WHEN c_acctbal * 50 <= 101850 THEN 1 ELSE 0 END THEN 0 ELSE 1 END AS married FROM customer""")
def _(t):
    sex = F.when(F.col("c_nationkey") % 2 == 0, "V").otherwise("H")
    return t.customer.select("c_custkey", C.marriage_index(F.col("c_custkey") % 60, sex, F.col("c_acctbal") * 50).alias("married"))


BANK = """bank AS (SELECT c_custkey AS ncodpers, CAST(CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE c_custkey % 117 END AS DOUBLE) AS age,
  CAST(CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE c_custkey % 270 - 5 END AS DOUBLE) AS antiguedad, CASE WHEN c_acctbal < 0 THEN NULL ELSE c_acctbal * 20 END AS renta,
  CASE WHEN c_nationkey = 3 THEN NULL ELSE n_name END AS nomprov, CASE c_nationkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'H' WHEN 2 THEN 'H' ELSE 'V' END AS sexo,
  n_name AS pais_residencia, c_mktsegment AS canal_entrada,
  CASE c_mktsegment WHEN 'MACHINERY' THEN '01 - TOP' WHEN 'BUILDING' THEN '03 - UNIVERSITARIO' WHEN 'HOUSEHOLD' THEN NULL ELSE '02 - PARTICULARES' END AS segmento,
  CASE c_custkey % 4 WHEN 0 THEN '1' WHEN 1 THEN NULL ELSE '0' END AS ind_nuevo, CASE c_custkey % 7 WHEN 0 THEN NULL WHEN 1 THEN '1' ELSE '0' END AS ind_actividad_cliente,
  CASE c_custkey % 5 WHEN 0 THEN 'P' WHEN 1 THEN '1.0' WHEN 2 THEN '2' WHEN 3 THEN '' ELSE '3.0' END AS indrel_1mes,
  strftime(TIMESTAMP '2010-01-01' + to_days(CAST(c_custkey % 1000 AS INT)), '%Y-%m-%d') AS fecha_alta FROM customer JOIN nation ON c_nationkey = n_nationkey)"""


def bank_customers(t):
    """Customers in the shape of the bank panel, with gaps made from their keys."""
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    return t.customer.join(t.nation, n == F.col("n_nationkey")).select(
        k.alias("ncodpers"), F.col("n_name").alias("pais_residencia"), F.col("c_mktsegment").alias("canal_entrada"),
        F.when(k % 11 != 0, k % 117).cast("double").alias("age"),
        F.when(k % 13 != 0, k % 270 - 5).cast("double").alias("antiguedad"),
        F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal") * 20).alias("renta"),
        F.when(n != 3, F.col("n_name")).alias("nomprov"),
        F.when(n % 5 == 0, None).when(n % 5 <= 2, "H").otherwise("V").alias("sexo"),
        F.when(F.col("c_mktsegment") == "MACHINERY", "01 - TOP").when(F.col("c_mktsegment") == "BUILDING", "03 - UNIVERSITARIO")
        .when(F.col("c_mktsegment") == "HOUSEHOLD", None).otherwise("02 - PARTICULARES").alias("segmento"),
        F.when(k % 4 == 0, "1").when(k % 4 == 1, None).otherwise("0").alias("ind_nuevo"),
        F.when(k % 7 == 0, None).when(k % 7 == 1, "1").otherwise("0").alias("ind_actividad_cliente"),
        F.element_at(F.array(*[F.lit(x) for x in ("P", "1.0", "2", "", "3.0")]), (k % 5 + 1).cast("int")).alias("indrel_1mes"),
        F.date_format(F.date_add(F.lit("2010-01-01").cast("date"), (k % 1000).cast("int")), "yyyy-MM-dd").alias("fecha_alta"))


AGES = """a1 AS (SELECT ncodpers, CASE WHEN age < 18 THEN (SELECT avg(age) FROM bank WHERE age BETWEEN 18 AND 30) WHEN age > 100 THEN (SELECT avg(age) FROM bank WHERE age BETWEEN 30 AND 100) ELSE age END AS age FROM bank),
  ages AS (SELECT ncodpers, round(coalesce(age, (SELECT median(age) FROM a1))) AS age FROM a1)"""
RENTA = """r1 AS (SELECT ncodpers, nomprov, coalesce(renta, m) AS renta FROM (SELECT ncodpers, coalesce(nomprov, 'UNKNOWN') nomprov, renta FROM bank)
  LEFT JOIN (SELECT coalesce(nomprov, 'UNKNOWN') nomprov, median(renta) m FROM bank GROUP BY 1) USING (nomprov)),
  rentas AS (SELECT ncodpers, nomprov, round(coalesce(renta, (SELECT median(renta) FROM r1)), 4) AS renta FROM r1)"""


@query("c08_outlier_to_usual", f"WITH {BANK}, {AGES} SELECT * FROM ages")
def _(t):
    return L.ages_to_usual(bank_customers(t).select("ncodpers", "age"), "age")


@query("c09_constant_fills", f"""WITH {BANK} SELECT ncodpers, coalesce(antiguedad, (SELECT min(antiguedad) FROM bank)) AS antiguedad, coalesce(ind_nuevo, '1') AS ind_nuevo,
  coalesce(age, (SELECT median(age) FROM bank)) AS age FROM bank""")
def _(t):
    b = bank_customers(t).select("ncodpers", "antiguedad", "ind_nuevo", "age")
    return L.fill_minimum(b, "antiguedad").fillna({"ind_nuevo": "1"}).withColumn("age", F.coalesce("age", b.agg(F.median("age")).scalar()))


@query("c10_group_median_fill", f"WITH {BANK}, {RENTA} SELECT * FROM rentas")
def _(t):
    b = bank_customers(t).select("ncodpers", "nomprov", "renta").fillna({"nomprov": "UNKNOWN"})
    return rounded(L.fill_group_median(b, "nomprov", "renta"), 4)


@query("c11_zero_fill", "SELECT c_custkey, coalesce(n, 0) AS n, coalesce(s, 0.0) AS s FROM customer LEFT JOIN (SELECT o_custkey, count(*) n, max(o_totalprice) s FROM orders GROUP BY 1) ON c_custkey = o_custkey")
def _(t):
    o = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"), F.max("o_totalprice").alias("s"))
    return t.customer.select("c_custkey").join(o, "c_custkey", "left").fillna(0)


@query("c12_fold_mean_fill", """WITH b AS (SELECT l_orderkey, l_linenumber, l_partkey, l_orderkey % 3 AS fold, nullif(l_tax, 0) AS tax FROM lineitem)
  SELECT l_orderkey, l_linenumber, l_partkey, fold, round(coalesce(tax, m), 6) AS tax FROM b JOIN (SELECT k AS fold, avg(tax) m FROM b, (SELECT unnest([0, 1, 2]) k) WHERE b.fold <> k GROUP BY 1) USING (fold)""")
def _(t):
    b = line(t, (F.col("l_orderkey") % 3).alias("fold"), F.nullif("l_tax", F.lit(0.0)).alias("tax"))
    return rounded(L.fold_mean_fill(b, ["tax"], "fold"))


@query("c13_above_centre", f"""SELECT {LINE}, CAST(l_extendedprice > (SELECT median(l_extendedprice) FROM lineitem) AS INT) AS l_extendedprice_above_median,
  CAST(l_extendedprice > (SELECT avg(l_extendedprice) FROM lineitem) AS INT) AS l_extendedprice_above_mean FROM lineitem""")
def _(t):
    return line(t, *L.above_centre(t.lineitem, ["l_extendedprice"]))


@query("c14_interactions", line_sql("l_quantity * l_linenumber AS prod", "l_quantity * l_quantity AS sq", "round(l_extendedprice / l_quantity, 8) AS ratio"))
def _(t):
    q = F.col("l_quantity")
    # quotients by up to 50 end within eight digits, so rounding meets no ties
    return rounded(line(t, (q * F.col("l_linenumber")).alias("prod"), (q * q).alias("sq"), (F.col("l_extendedprice") / q).alias("ratio")), 8)


@query("c15_square_code", f"""SELECT {LINE}, CASE WHEN a = 19 THEN -1 ELSE a END AS a, CASE WHEN (n - a) // 31 = 51 THEN -1 ELSE (n - a) // 31 END AS m
  FROM (SELECT *, CASE WHEN n % 31 = 0 THEN 31 ELSE n % 31 END AS a FROM (SELECT *, CAST(round(power(40 * sqrt(l_quantity * 37) / 40, 2)) AS BIGINT) AS n FROM lineitem))""")
def _(t):
    a, m = C.square_code(F.sqrt(F.col("l_quantity") * 37) / 40)
    return line(t, a.alias("a"), m.alias("m"))


@query("c16_unit_range", f"SELECT {LINE}, round((l_extendedprice - (SELECT min(l_extendedprice) FROM lineitem)) / (SELECT max(l_extendedprice) - min(l_extendedprice) FROM lineitem), 6) AS u FROM lineitem")
def _(t):
    return rounded(line(t, C.scaled_to_unit(t.lineitem, "l_extendedprice").alias("u")))


@query("c17_class_cap", f"WITH {CLAIM} SELECT {LINE}, round(least(l_quantity * 2, (SELECT max(l_quantity) + 2 * stddev_samp(l_quantity) FROM cl WHERE target = 1)), 6) AS v FROM cl")
def _(t):
    df = line(t, (F.col("l_quantity") * 2).alias("v"), "l_quantity", (F.col("l_returnflag") == "R").cast("int").alias("target"))
    one = df.where("target = 1").select(F.col("l_quantity").alias("v"), "target")
    return rounded(df.withColumn("v", L.cap_by_class(one, "v", "target")).select(*IDS, "v"))


@query("c18_prior_correction", f"WITH {PRED} SELECT {LINE}, round(1.2 * p1 / (1.2 * p1 + 0.9 * (1 - p1)), 6) AS c FROM pr")
def _(t):
    return rounded(predictions(t).select(*IDS, C.prior_correction(F.col("p1"), 0.9, 1.2).alias("c")))


@query("c19_prior_weight", f"""WITH {PRED}, d AS (SELECT p1 AS x, count(*) AS c FROM pr GROUP BY 1), g AS (SELECT unnest(range(1, 100000)) / 100000 AS w),
  m AS (SELECT w, sum(c * w * x / (w * x + (1 - w) * (1 - x))) / sum(c) AS m, CAST(sum(c) AS BIGINT) AS n FROM d, g GROUP BY 1)
  SELECT round(m, 3) AS corrected_mean, n, round(w, 3) AS weight FROM m ORDER BY abs(m - 0.4) LIMIT 1""")
def _(t):
    df = predictions(t)
    w = C.solve_prior_weight(df, "p1", 0.4)
    x = F.col("p1")
    out = df.agg(F.avg(w * x / (w * x + (1 - w) * (1 - x))).alias("corrected_mean"), F.count(F.lit(1)).alias("n")).withColumn("weight", F.lit(w))
    return rounded(out, 3)


@query("c20_sigmoid_logloss", f"WITH {PRED} SELECT {LINE}, round(1 / (1 + exp(-(p1 - p2))), 6) AS s, round(CASE WHEN y = 1 THEN -ln(p1) ELSE -ln(1 - p1) END, 6) AS ll FROM pr")
def _(t):
    return rounded(predictions(t).select(*IDS, C.sigmoid(F.col("p1") - F.col("p2")).alias("s"), C.bounded_logloss(F.col("y"), F.col("p1")).alias("ll")))


@query("c21_month_of_text", "SELECT o_orderkey, CAST(strftime(o_orderdate, '%m') AS BIGINT) AS m, CAST(year(o_orderdate) AS INT) AS y FROM orders")
def _(t):
    text = F.date_format("o_orderdate", "yyyy-MM-dd")
    return t.orders.select("o_orderkey", C.month_or_hash(text, F.col("o_orderkey")).alias("m"), F.year(F.to_date(text)).alias("y"))


@query("c22_polarity_token", f"""SELECT {LINE}, 'polarity' || CASE WHEN s < 0 THEN 'negative' WHEN s = 0 THEN 'neutral' ELSE 'positive' END ||
  list_extract(['zero', 'one', 'two', 'three', 'four', 'five', 'six', 'seven', 'eight', 'nine', 'ten'], abs(s) + 1) AS token FROM (SELECT *, CAST(l_quantity AS INT) % 21 - 10 AS s FROM lineitem)""")
def _(t):
    return line(t, C.polarity_token(F.col("l_quantity").cast("int") % 21 - 10).alias("token"))


@query("c23_softmax_in_bag", f"""SELECT {LINE}, l_suppkey, round(exp(l_quantity / 10 - m) / z, 6) AS w FROM lineitem JOIN (SELECT l_orderkey, max(l_quantity) / 10 m FROM lineitem GROUP BY 1) USING (l_orderkey)
  JOIN (SELECT l_orderkey, sum(exp((l_quantity - mm) / 10)) z FROM lineitem JOIN (SELECT l_orderkey, max(l_quantity) mm FROM lineitem GROUP BY 1) USING (l_orderkey) GROUP BY 1) USING (l_orderkey)""")
def _(t):
    df = line(t, "l_suppkey", (F.col("l_quantity") / 10).alias("x"))
    return rounded(C.softmax_in_group(df, "l_orderkey", "x", "w").select(*IDS, "l_suppkey", "w"))


@query("c24_clip", f"WITH {PRED} SELECT {LINE}, least(greatest(p3, 0.1), 0.7) AS p FROM pr")
def _(t):
    return predictions(t).select(*IDS, C.clip(F.col("p3"), 0.1, 0.7).alias("p"))


INCOME = {"NATION_1": 60000.0, "NATION_2": 120500.0, "NATION_7": 83000.0}
HIST = [1, 2, 3, 4, 5, 6]
COUNTRIES = ({f"NATION_{i}": i + 1 for i in range(12)}, 0)
CHANNELS = ({"AUTOMOBILE": 0, "BUILDING": 1, "MACHINERY": 2}, 9)


def vector_sql():
    inc = "coalesce(renta, CASE nomprov " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in INCOME.items()) + " END, 103689.0)"
    states = ", ".join(f"coalesce(max(CASE WHEN w = 4 - {k} THEN {p} END), 0) AS {p}_{k}" for k in [0, *HIST] for p in FLAGS)
    return f"""{BANK}, {PANEL}, st AS (SELECT user_id AS ncodpers, {states} FROM pn GROUP BY 1 HAVING max(CASE WHEN w = 4 THEN 1 ELSE 0 END) = 1),
    vec AS (SELECT st.*, CASE WHEN sexo = 'V' THEN 0 WHEN sexo = 'H' THEN 1 ELSE 2 END AS sexo_code, CASE WHEN ind_nuevo = '0' THEN 0 ELSE 1 END AS ind_nuevo_code,
      CASE indrel_1mes WHEN '1.0' THEN 1 WHEN '2' THEN 2 WHEN '3.0' THEN 3 WHEN 'P' THEN 5 ELSE 0 END AS indrel_1mes_code,
      CASE ind_actividad_cliente WHEN '0' THEN 0 WHEN '1' THEN 1 ELSE 2 END AS ind_actividad_cliente_code,
      CASE segmento WHEN '02 - PARTICULARES' THEN 0 WHEN '03 - UNIVERSITARIO' THEN 1 WHEN '01 - TOP' THEN 2 ELSE 3 END AS segmento_code,
      CASE pais_residencia {' '.join(f"WHEN '{k}' THEN {v}" for k, v in COUNTRIES[0].items())} ELSE {COUNTRIES[1]} END AS pais_residencia_code,
      CASE canal_entrada {' '.join(f"WHEN '{k}' THEN {v}" for k, v in CHANNELS[0].items())} ELSE {CHANNELS[1]} END AS canal_entrada_code,
      round((least(greatest(coalesce(age, 40), 18), 100) - 18) / 82, 4) AS age_scaled, round(least(greatest(coalesce(antiguedad, 0), 0), 256) / 256, 4) AS seniority_scaled,
      round(least(greatest({inc}, 0), 1500000) / 1500000, 6) AS income_scaled,
      CASE WHEN coalesce(age, 40) <= 19 THEN 0 WHEN coalesce(age, 40) <= 40 THEN 1 WHEN coalesce(age, 40) <= 55 THEN 2 ELSE 3 END AS age_group,
      CASE WHEN s <= 50 THEN 0 WHEN s <= 100 THEN 1 WHEN s <= 150 THEN 2 WHEN s <= 200 THEN 3 WHEN s >= 202 THEN 4 ELSE 5 END AS seniority_group,
      CASE WHEN {inc} BETWEEN 0 AND 60000 THEN 0 WHEN {inc} BETWEEN 60001 AND 120000 THEN 1 WHEN {inc} >= 120001 THEN 2 ELSE 3 END AS income_group,
      CASE WHEN coalesce(age, 40) <= 28 - CASE WHEN sexo = 'V' THEN 2 ELSE 0 END - CASE WHEN {inc} <= 101850 THEN 1 ELSE 0 END THEN 0 ELSE 1 END AS marriage,
      CASE coalesce(sexo, 'N') || coalesce(ind_actividad_cliente, 'N') WHEN 'H1' THEN 0 WHEN 'H0' THEN 1 WHEN 'HN' THEN 2 WHEN 'V1' THEN 3 WHEN 'V0' THEN 4 WHEN 'VN' THEN 5 WHEN 'N1' THEN 6 WHEN 'N0' THEN 7 ELSE 8 END AS sex_activity,
      CASE (CASE WHEN ind_nuevo = '0' THEN 0 ELSE 1 END) + 10 * (CASE segmento WHEN '02 - PARTICULARES' THEN 0 WHEN '03 - UNIVERSITARIO' THEN 1 WHEN '01 - TOP' THEN 2 ELSE 3 END)
        WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 10 THEN 2 WHEN 11 THEN 3 WHEN 12 THEN 4 WHEN 20 THEN 5 WHEN 21 THEN 6 WHEN 30 THEN 7 WHEN 31 THEN 8 END AS new_segment,
      CAST(substr(fecha_alta, 6, 2) AS BIGINT) AS join_month, {' + '.join(f'{p}_1' for p in FLAGS)} AS total_before
    FROM st JOIN (SELECT *, least(greatest(coalesce(antiguedad, 0), 0), 256) AS s FROM bank) USING (ncodpers))"""


def vectors(t):
    return P.customer_vectors(weekly_panel(t).withColumnRenamed("user_id", "ncodpers"), bank_customers(t), FLAGS, "w", 4, HIST, INCOME, 103689.0,
                              {"pais_residencia": COUNTRIES, "canal_entrada": CHANNELS})


@query("f12_customer_vectors", f"WITH {vector_sql()} SELECT * FROM vec")
def _(t):
    return vectors(t)


@query("f12_new_product_rows", f"WITH {vector_sql()} " + " UNION ALL ".join(f"SELECT ncodpers, total_before, {i} AS label FROM vec WHERE {p}_0 = 1 AND {p}_1 = 0" for i, p in enumerate(FLAGS)))
def _(t):
    return P.new_product_rows(vectors(t), FLAGS).select("ncodpers", "total_before", "label")


@query("f13_clean_customers", f"""WITH {BANK}, {AGES}, {RENTA} SELECT ncodpers, ages.age, greatest(coalesce(antiguedad, (SELECT min(antiguedad) FROM bank)), 0) AS antiguedad, rentas.renta, rentas.nomprov,
  coalesce(sexo, 'UNKNOWN') AS sexo, segmento, coalesce(ind_nuevo, '1') AS ind_nuevo, coalesce(ind_actividad_cliente, '1') AS ind_actividad_cliente,
  CASE indrel_1mes WHEN '' THEN 1 WHEN 'P' THEN 5 ELSE CAST(CAST(indrel_1mes AS DOUBLE) AS INT) END AS indrel_1mes, fecha_alta, pais_residencia, canal_entrada
  FROM bank JOIN ages USING (ncodpers) JOIN rentas USING (ncodpers)""")
def _(t):
    return rounded(P.clean_customers(bank_customers(t)), 4)
