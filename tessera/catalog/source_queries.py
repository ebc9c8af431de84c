"""Sources and sinks (IO1-IO14), streams (ST1-ST2), click, demand and claim tables."""

from pyspark.sql import functions as F

from tessera.catalog.aggregate_queries import CLICKS, DEMAND, WORDS, clicks, demand
from tessera.catalog.base import query
from tessera.functions.text import ascii_words
from tessera.operators.aggregates import log_count_ratio
from tessera.operators.frames import rounded
from tessera.operators.ranges import dense_codes
from tessera.plans import claims as K
from tessera.plans import clicks as CK
from tessera.plans import demand as D
from tessera.sources import readers as R
from tessera.sources import writers as W
from tessera.session import scratch_path
from tessera.streaming import clicks as ST

CUSTOMER = "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"


def as_csv(t, df, name, **kw):
    path = scratch_path(t.spark, name)
    W.write_delimited(df, path, **kw)
    return path


@query("io01_csv_scan", "SELECT * FROM customer")
def _(t):
    return R.read_delimited(t.spark, as_csv(t, t.customer, "customer"), CUSTOMER)


@query("io02_csv_column_subset", "SELECT c_custkey, c_acctbal FROM customer")
def _(t):
    return R.read_delimited(t.spark, as_csv(t, t.customer, "customer"), CUSTOMER, columns=["c_custkey", "c_acctbal"])


@query("io03_csv_declared_types", "SELECT c_custkey, c_name, CAST(c_nationkey AS SMALLINT) AS c_nationkey, CAST(c_acctbal AS FLOAT) AS c_acctbal, c_mktsegment FROM customer")
def _(t):
    schema = CUSTOMER.replace("c_nationkey int", "c_nationkey smallint").replace("c_acctbal double", "c_acctbal float")
    return R.read_delimited(t.spark, as_csv(t, t.customer, "customer"), schema)


@query("io04_tsv_scan", "SELECT * FROM part")
def _(t):
    schema = ", ".join(f"{c} {k}" for c, k in t.part.dtypes)
    return R.read_delimited(t.spark, as_csv(t, t.part, "part", sep="\t"), schema, sep="\t", quoted=False)


@query("io05_null_sentinel", "SELECT l_orderkey, l_linenumber, nullif(l_tax, 0) AS l_tax, nullif(l_discount, 0) AS l_discount FROM lineitem")
def _(t):
    li = t.lineitem.select("l_orderkey", "l_linenumber", *[F.when(F.col(c) == 0, -1.0).otherwise(F.col(c)).alias(c) for c in ("l_tax", "l_discount")])
    return R.null_sentinels(li, -1.0, ["l_tax", "l_discount"])


@query("io06_bounded_scan", "SELECT * FROM customer ORDER BY c_custkey LIMIT 500")
def _(t):
    return R.read_bounded(t.customer, ["c_custkey"], 500)


@query("io07_glob_with_file_name", "SELECT count(*) AS n, round(sum(c_acctbal), 2) AS s, true AS named FROM customer")
def _(t):
    root = scratch_path(t.spark, "parts")
    for i in range(3):
        W.write_delimited(t.customer.where(F.col("c_custkey") % 3 == i), f"{root}/model_{i}")
    df = R.read_delimited(t.spark, f"{root}/model_*", CUSTOMER, source_column="src")
    return df.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("c_acctbal"), 2).alias("s"), F.min(F.col("src").endswith(".csv")).alias("named"))


@query("io08_key_value_lines", "SELECT c_name AS key, c_mktsegment AS value FROM customer")
def _(t):
    path = scratch_path(t.spark, "pairs")
    t.customer.select(F.concat_ws("->", "c_name", "c_mktsegment")).write.text(path)
    return R.read_key_values(t.spark, path)


@query("io09_word_vectors", "SELECT 'w' || vec_id AS word, len(embedding) AS d, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 4) AS s FROM embeddings")
def _(t):
    path = scratch_path(t.spark, "vectors")
    t.embeddings.select(F.concat_ws(" ", F.concat(F.lit("w"), "vec_id"), F.array_join(F.col("embedding").cast("array<string>"), " "))).write.text(path)
    total = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x)
    return R.read_word_vectors(t.spark, path).select("word", F.size("vector").cast("long").alias("d"), F.round(total, 4).alias("s"))


@query("io10_csv_sink_fixed_decimals", "SELECT l_orderkey, printf('%.3f', l_extendedprice) AS l_extendedprice FROM lineitem")
def _(t):
    path = as_csv(t, t.lineitem.select("l_orderkey", "l_extendedprice"), "lines", decimals=3)
    return R.read_delimited(t.spark, path, "l_orderkey long, l_extendedprice string")


@query("io11_materialised_stage", "SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1")
def _(t):
    return W.materialise(t.lineitem.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n")), scratch_path(t.spark, "stage"))


NB = f"""w AS (SELECT doc_id, toxic, unnest({WORDS}) AS word FROM documents JOIN labels USING (doc_id)),
  c AS (SELECT word, count(*) FILTER (toxic = 1) + 1 AS p, count(*) FILTER (toxic = 0) + 1 AS q FROM w GROUP BY 1),
  r AS (SELECT word, dense_rank() OVER (ORDER BY word) AS idx, ln(p / (SELECT sum(p) FROM c)) - ln(q / (SELECT sum(q) FROM c)) AS ratio FROM c)"""


@query("io12_svmlight_lines", f"""WITH {NB} SELECT doc_id, toxic || ' ' || string_agg(printf('%d:%.6f', idx, ratio), ' ' ORDER BY idx) AS line
  FROM (SELECT DISTINCT doc_id, toxic, word FROM w) JOIN r USING (word) GROUP BY doc_id, toxic""")
def _(t):
    words = t.documents.join(t.labels, "doc_id").select("doc_id", "toxic", F.explode(ascii_words("text")).alias("word"))
    ratios = log_count_ratio(words, "word", "toxic").join(dense_codes(words, "word", "idx"), "word")
    return W.svmlight_lines(words.distinct().join(ratios, "word"), "doc_id", "toxic", "idx", "ratio")


FFM = """ent AS (SELECT field, kind, value, row_number() OVER (ORDER BY field, kind, value) - 1 AS f FROM (
  SELECT DISTINCT 'c_mktsegment' AS field, 0 AS kind, c_mktsegment AS value FROM customer UNION ALL SELECT DISTINCT 'c_nationkey', 0, CAST(c_nationkey AS VARCHAR) FROM customer
  UNION ALL SELECT DISTINCT 'age', 0, CAST(c_custkey % 90 AS VARCHAR) FROM customer
  UNION ALL SELECT 'c_mktsegment', 1, '' UNION ALL SELECT 'c_nationkey', 1, '' UNION ALL SELECT 'age', 1, ''))"""


@query("io13_ffm_lines", f"""WITH {FFM} SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN 1 ELSE 0 END || ' 0:' || (SELECT f FROM ent WHERE field = 'age' AND kind = 1) || ':' || (c_custkey % 90)
  || ' 1:' || m.f || ':1 2:' || n.f || ':1' AS line FROM customer JOIN ent m ON m.field = 'c_mktsegment' AND m.kind = 0 AND m.value = c_mktsegment
  JOIN ent n ON n.field = 'c_nationkey' AND n.kind = 0 AND n.value = CAST(c_nationkey AS VARCHAR)""")
def _(t):
    df = t.customer.select("c_custkey", (F.col("c_acctbal") > 0).cast("int").alias("y"), (F.col("c_custkey") % 90).alias("age"), "c_mktsegment", F.col("c_nationkey").cast("string").alias("c_nationkey"))
    return W.ffm_lines(df, "c_custkey", "y", ["c_mktsegment", "c_nationkey"], ["age"])


@query("io14_vocabulary", f"WITH {CLICKS} SELECT feature, count(*) AS n FROM (SELECT 'ad_' || ad AS feature FROM clicks UNION ALL SELECT 'k_' || k FROM clicks) GROUP BY 1 HAVING count(*) >= 70")
def _(t):
    return W.materialise(W.vocabulary(clicks(t), ["ad", "k"], 70), scratch_path(t.spark, "vocabulary"))


@query("e14_ffm_index", f"WITH {FFM} SELECT field, kind, value, f AS feature FROM ent")
def _(t):
    df = t.customer.select((F.col("c_custkey") % 90).alias("age"), "c_mktsegment", F.col("c_nationkey").cast("string").alias("c_nationkey"))
    return W.ffm_index(df, ["age", "c_mktsegment", "c_nationkey"])


def event_stream(t):
    return ST.read_events(t.spark, t.path("events"), t.events.schema)


class StreamTables:
    """The click view over a stream in place of the static events table."""

    def __init__(self, t):
        self.events = event_stream(t)


@query("st01_running_counts", f"""WITH {CLICKS} SELECT field, value, count(*) FILTER (clicked = 1) AS pos, count(*) FILTER (clicked = 0) AS neg, count(*) AS total, round(avg(clicked), 6) AS ratio
  FROM (SELECT 'ad' AS field, CAST(ad AS VARCHAR) AS value, clicked FROM clicks UNION ALL SELECT 'h', CAST(h AS VARCHAR), clicked FROM clicks) GROUP BY ALL""")
def _(t):
    return rounded(ST.running_counts(clicks(StreamTables(t)), ["ad", "h"], "clicked"))


CLICK_ROWS = f"""ck AS (SELECT event_id AS row_id, clicked, CAST(event_id % 997 AS BIGINT) AS display_id, ad AS ad_id, CAST(ad AS VARCHAR) AS uuid, k FROM clicks),
  ads AS (SELECT c_custkey AS ad_id, CAST(c_nationkey AS VARCHAR) AS document_id, c_mktsegment AS segment FROM customer WHERE c_custkey % 7 > 0),
  dis AS (SELECT s_suppkey AS display_id, CAST(s_suppkey % 3 AS VARCHAR) AS platform, r_name AS loc_country, n_name AS loc_state, s_name AS loc_dma
    FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
  full_rows AS (SELECT row_id, clicked, 'display_id=' || display_id || ' ad_id=' || ad_id || ' document_id=' || coalesce(document_id, '0') || ' segment=' || coalesce(segment, '0') || ' uuid=' || uuid ||
    ' platform=' || coalesce(platform, '0') || ' loc_country=' || coalesce(loc_country, '0') || ' loc_state=' || coalesce(loc_state, '0') || ' loc_dma=' || coalesce(loc_dma, '0') ||
    ' leakage_row_found=' || CASE WHEN ad_id % 2 = 0 AND EXISTS (SELECT 1 FROM customer WHERE c_custkey = ad_id AND CAST(c_nationkey AS VARCHAR) = coalesce(document_id, '0')) THEN 1 ELSE 0 END AS fields
    FROM ck LEFT JOIN ads USING (ad_id) LEFT JOIN dis USING (display_id))"""


def click_parts(t, events=None):
    base = clicks(events or t)
    ck = base.select(F.col("event_id").alias("row_id"), "clicked", (F.col("event_id") % 997).alias("display_id"), F.col("ad").alias("ad_id"), F.col("ad").cast("string").alias("uuid"))
    ads = t.customer.where("c_custkey % 7 > 0").select(F.col("c_custkey").alias("ad_id"), F.col("c_nationkey").cast("string").alias("document_id"), F.col("c_mktsegment").alias("segment"))
    s = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    displays = s.select(F.col("s_suppkey").alias("display_id"), (F.col("s_suppkey") % 3).cast("string").alias("platform"), F.concat_ws(">", "r_name", "n_name", "s_name").alias("geo_location"))
    even = t.customer.where("c_custkey % 2 = 0")
    leaks = even.groupBy(F.col("c_nationkey").cast("string").alias("document_id"), F.floor(F.col("c_custkey") / 1000).alias("part")).agg(
        F.concat_ws(" ", F.collect_list(F.col("c_custkey").cast("string"))).alias("uuids"))
    return ck, ads, displays, leaks


@query("st02_stream_enrichment", f"WITH {CLICKS}, {CLICK_ROWS} SELECT * FROM full_rows")
def _(t):
    _, ads, displays, leaks = click_parts(t)
    stream, *_ = click_parts(t, StreamTables(t))
    return ST.enrich(stream, lambda df: CK.click_rows(df, ads, displays, leaks))


@query("f14_click_rows", f"WITH {CLICKS}, {CLICK_ROWS} SELECT * FROM full_rows")
def _(t):
    return CK.click_rows(*click_parts(t))


@query("f15_ad_ranking", f"""WITH {CLICKS}, a AS (SELECT k AS display_id, ad AS ad_id, clicked, ad || '_' || CASE WHEN h % 3 = 0 THEN '2' ELSE CAST(h % 3 AS VARCHAR) END AS kk, event_id FROM clicks),
  tr AS (SELECT * FROM a WHERE event_id % 5 > 0), te AS (SELECT * FROM a WHERE event_id % 5 = 0), p AS (SELECT avg(clicked) AS p FROM tr),
  r AS (SELECT kk, (sum(clicked) + 16 * (SELECT p FROM p)) / (count(*) + 16) AS prob FROM tr GROUP BY 1),
  s AS (SELECT display_id, ad_id, max(coalesce(prob, p)) AS prob FROM te LEFT JOIN r USING (kk), p GROUP BY ALL)
  SELECT display_id, string_agg(CAST(ad_id AS VARCHAR), ' ' ORDER BY round(prob, 9) DESC, ad_id) AS ad_ids FROM s GROUP BY 1""")
def _(t):
    c = clicks(t).select("event_id", F.col("k").alias("display_id"), F.col("ad").alias("ad_id"), "clicked", (F.col("h") % 3).cast("string").alias("platform"))
    return CK.ad_ranking(c.where("event_id % 5 > 0"), c.where("event_id % 5 = 0"))


@query("f16_demand_prediction", f"""WITH {DEMAND}, y AS (SELECT *, ln(1 + demand) AS y FROM dm), fit AS (SELECT * FROM y WHERE week < 11),
  pca AS (SELECT product, client, agency, avg(y) a FROM fit GROUP BY ALL), pr AS (SELECT product, route, avg(y) b FROM fit GROUP BY ALL), p AS (SELECT product, avg(y) c FROM fit GROUP BY 1),
  j AS (SELECT * FROM y LEFT JOIN pca USING (product, client, agency) LEFT JOIN pr USING (product, route) LEFT JOIN p USING (product) WHERE week >= 11),
  l AS (SELECT regr_slope(y, a) s1, regr_intercept(y, a) i1, regr_slope(y, b) s2, regr_intercept(y, b) i2, regr_slope(y, c) s3, regr_intercept(y, c) i3, avg(y) AS i4 FROM j WHERE week = 11)
  SELECT client, product, agency, demand, round(coalesce((exp(a) - 1) * s1 + i1, (exp(b) - 1) * s2 + i2, (exp(c) - 1) * s3 + i3, exp((SELECT avg(y) FROM fit)) - 1 + i4), 5) AS pred FROM j, l WHERE week = 12""")
def _(t):
    df = demand(t)
    out = D.fallback_prediction(df.where("week < 11"), df.where("week = 11"), df.where("week = 12"))
    return rounded(out.select("client", "product", "agency", "demand", "pred"), 5)


def counts_sql():
    keys = ["week", "agency", "channel", "route", "client", "product"]
    from itertools import combinations
    groups = [(k,) for k in keys] + list(combinations(keys, 2)) + D.TRIPLES
    cols = [f"count(*) OVER (PARTITION BY {', '.join(g)}) AS {'_'.join(g)}_cnt" for g in groups]
    cols += [f"dense_rank() OVER (ORDER BY {k}) AS {k}_id" for k in keys]
    return "SELECT *, " + ", ".join(cols) + " FROM dc"


DEMAND_CHANNEL = """dc AS (SELECT CAST(month(l_shipdate) AS INT) AS week, o_custkey AS client, l_partkey AS product, l_suppkey AS agency, c_nationkey AS route, l_linenumber AS channel, l_quantity AS demand
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey)"""


@query("f17_count_features", f"WITH {DEMAND_CHANNEL} {counts_sql()}")
def _(t):
    o = t.orders.select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("client"))
    c = t.customer.select(F.col("c_custkey").alias("client"), F.col("c_nationkey").alias("route"))
    df = t.lineitem.join(o, "l_orderkey").join(c, "client").select(
        F.month("l_shipdate").alias("week"), "client", F.col("l_partkey").alias("product"), F.col("l_suppkey").alias("agency"),
        "route", F.col("l_linenumber").alias("channel"), F.col("l_quantity").alias("demand"))
    return D.count_features(df)


@query("f25_claim_features", """WITH b AS (SELECT l_orderkey, l_linenumber, l_partkey, sqrt(l_quantity * 37) / 40 AS reg, CASE WHEN l_tax = 0 THEN -1.0 ELSE l_tax END AS tax, CASE WHEN l_discount = 0 THEN -1.0 ELSE l_discount END AS disc,
    l_extendedprice / 1000 AS size, CAST(l_returnflag = 'A' AS INT) AS fa, CAST(l_returnflag = 'N' AS INT) AS fn, CAST(l_returnflag = 'R' AS INT) AS fr, l_linestatus AS cat1, l_linenumber AS cat2 FROM lineitem),
  q AS (SELECT *, CAST(round(power(40 * reg, 2)) AS BIGINT) AS n FROM b), a AS (SELECT *, CASE WHEN n % 31 = 0 THEN 31 ELSE n % 31 END AS a0 FROM q)
  SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN a0 = 19 THEN -1 ELSE a0 END AS reg_a, CASE WHEN (n - a0) // 31 = 51 THEN -1 ELSE (n - a0) // 31 END AS reg_m, round(size * reg, 5) AS size_x_reg, round(size * size, 4) AS size_sq,
    CAST(tax = -1 AS INT) + CAST(disc = -1 AS INT) AS negative_one_vals, fa + 2 * fn + 3 * fr AS flag_code,
    CAST(tax > (SELECT median(tax) FROM b) AS INT) AS tax_above_median, CAST(tax > (SELECT avg(tax) FROM b) AS INT) AS tax_above_mean,
    CAST(disc > (SELECT median(disc) FROM b) AS INT) AS disc_above_median, CAST(disc > (SELECT avg(disc) FROM b) AS INT) AS disc_above_mean,
    dense_rank() OVER (ORDER BY cat1 || '_' || cat2) - 1 AS cat1_plus_cat2 FROM a""")
def _(t):
    li = t.lineitem
    base = li.select("l_orderkey", "l_linenumber", "l_partkey", (F.sqrt(F.col("l_quantity") * 37) / 40).alias("reg"),
                     F.when(F.col("l_tax") == 0, -1.0).otherwise(F.col("l_tax")).alias("tax"), F.when(F.col("l_discount") == 0, -1.0).otherwise(F.col("l_discount")).alias("disc"),
                     (F.col("l_extendedprice") / 1000).alias("size"), *[(F.col("l_returnflag") == v).cast("int").alias(f"f{v.lower()}") for v in "ANR"],
                     F.col("l_linestatus").alias("cat1"), F.col("l_linenumber").alias("cat2"))
    out = K.claim_features(base, ["tax", "disc"], ["fa", "fn", "fr"], [("cat1", "cat2")], "reg", "size")
    out = out.withColumn("size_sq", F.round("size_sq", 4)).withColumn("size_x_reg", F.round("size_x_reg", 5))
    return out.drop("reg", "tax", "disc", "size", "fa", "fn", "fr", "cat1", "cat2")
