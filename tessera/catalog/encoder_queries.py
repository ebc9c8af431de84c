"""Encoders and feature matrices (E1-E23) and the matrix tables."""

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tessera.catalog.base import query
from tessera.catalog.views import basket_lines
from tessera.functions import text as X
from tessera.functions.rules import QUESTION_STOP_WORDS
from tessera.operators import encoders as E
from tessera.operators.frames import rounded
from tessera.operators.vocabulary import supported_ids
from tessera.plans import matrices as P

LINE = "l_orderkey, l_linenumber, l_partkey"
IDS = ["l_orderkey", "l_linenumber", "l_partkey"]


STOP = "[" + ", ".join(f"'{w}'" for w in QUESTION_STOP_WORDS) + "]"


def line(t, *cols):
    return t.lineitem.select(*IDS, *cols)


def dealt_texts(df, key):
    """Texts dealt by their key: what is counted per text later needs no shuffle of its terms."""
    return df.select(key, "text").repartition(key)


def hot(c, values):
    return [f"CAST({c} = {v!r} AS INT) AS \"{c}_{v}\"" for v in values]


@query("e01_label_codes", "SELECT p_partkey, dense_rank() OVER (ORDER BY p_name) - 1 AS code FROM part")
def _(t):
    train, test = t.part.where("p_partkey % 4 > 0"), t.part.where("p_partkey % 4 = 0")
    return t.part.join(E.label_codes([train, test], "p_name", "code"), "p_name").select("p_partkey", "code")


@query("e02_one_hot", f"SELECT {LINE}, {', '.join(hot('l_returnflag', 'ANR') + hot('l_linestatus', 'FO'))} FROM lineitem")
def _(t):
    return line(t, *E.one_hot(t.lineitem, ["l_returnflag", "l_linestatus"]))


@query("e03_one_hot_few_values", f"SELECT {LINE}, {', '.join(hot('l_returnflag', 'ANR'))} FROM lineitem")
def _(t):
    cols = E.few_valued(t.lineitem, ["l_returnflag", "l_linestatus", "l_quantity", "l_discount"])
    return line(t, *E.one_hot(t.lineitem, cols))


@query("e04_one_hot_min_count", "SELECT p_partkey, CAST(h AS BIGINT) AS kept FROM (SELECT p_partkey, CASE WHEN count(*) OVER (PARTITION BY p_name) >= 35 THEN 1 ELSE 0 END AS h FROM part)")
def _(t):
    cols = E.one_hot(t.part, ["p_name"], min_count=35)
    return t.part.select("p_partkey", sum((c for c in cols), F.lit(0)).cast("long").alias("kept"))


@query("e05_sparse_labels", "SELECT p_partkey, dense_rank() OVER (ORDER BY p_brand) - 1 AS slot, 1.0::DOUBLE AS value FROM part")
def _(t):
    return E.sparse_one_hot(t.part, "p_partkey", ["p_brand"])


@query("e06_count_vectors", r"""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\pL\pN_][\pL\pN_]+')) AS w, generate_subscripts(regexp_extract_all(lower(text), '[\pL\pN_][\pL\pN_]+'), 1) AS i FROM documents),
  g AS (SELECT doc_id, 1 AS n, w AS g FROM w UNION ALL SELECT doc_id, 2, w || ' ' || x FROM (SELECT doc_id, w, lead(w) OVER (PARTITION BY doc_id ORDER BY i) AS x FROM w) WHERE x IS NOT NULL),
  k AS (SELECT n, g, row_number() OVER (ORDER BY n, g) - 1 AS slot FROM g GROUP BY n, g HAVING count(DISTINCT doc_id) >= 3)
  SELECT doc_id, slot, CAST(count(*) AS DOUBLE) AS value FROM g JOIN k USING (n, g) GROUP BY ALL""")
def _(t):
    w = dealt_texts(t.documents, "doc_id").select("doc_id", X.regex_words("text").alias("w"))
    grams = F.array(*[F.struct(F.lit(n).alias("n"), X.word_ngrams(F.col("w"), n, " ").alias("g")) for n in (1, 2)])
    rows = w.select("doc_id", F.explode(grams).alias("x")).select("doc_id", F.col("x.n").alias("n"), F.explode("x.g").alias("g"))
    return E.count_vectors(rows, "doc_id", "n", "g", min_df=3)


TFIDF = """st AS (SELECT term, count(*) AS df, sum(tf) AS total FROM c GROUP BY 1 {having}), k AS (SELECT * FROM st {top}),
  wt AS (SELECT doc_id, term, (1 + ln(tf)) * (ln((1 + (SELECT count(DISTINCT doc_id) FROM c)) / (1 + df)) + 1) AS w FROM c JOIN k USING (term))
  SELECT doc_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS value FROM wt"""


@query("e07_word_tfidf", r"WITH c AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\pL\pN_][\pL\pN_]+')) AS term FROM documents) GROUP BY ALL), "
       + TFIDF.format(having="HAVING count(*) >= 2", top="ORDER BY total DESC, term LIMIT 5000"))
def _(t):
    docs = dealt_texts(t.documents, "doc_id").select("doc_id", X.regex_words("text").alias("w"))
    texts = docs.where(F.size("w") > 0).agg(F.count_distinct("doc_id")).scalar()
    return rounded(E.tfidf(docs.select("doc_id", F.explode("w").alias("term")), "doc_id", "term", min_df=2, max_features=5000, texts=texts))


CHAR_TERMS = " UNION ALL ".join(f"SELECT conv_id || '-' || turn AS doc_id, unnest(list_transform(range(1, greatest(length(text) - {n - 2}, 1)), lambda i: substr(text, i, {n}))) AS term FROM conversations" for n in range(2, 7))


@query("e08_char_tfidf", f"WITH c AS (SELECT doc_id, term, count(*) AS tf FROM ({CHAR_TERMS}) GROUP BY ALL), " + TFIDF.format(having="", top="ORDER BY total DESC, term LIMIT 2000"))
def _(t):
    text = dealt_texts(t.conversations.withColumn("doc_id", F.concat_ws("-", "conv_id", "turn")), "doc_id")
    texts = text.where(F.length("text") > 1).agg(F.count_distinct("doc_id")).scalar()
    return rounded(E.tfidf(E.char_gram_rows(text, "doc_id", "text", 2, 6), "doc_id", "term", max_features=2000, texts=texts))


SLOT = "('0x' || substr(md5({}), 1, 15))::BIGINT % {}"


@query("e09_hashed_bag", f"""WITH n AS (SELECT p_partkey, string_split(p_name, ' ') AS w FROM part), g AS (SELECT DISTINCT p_partkey, unnest(w) AS g, 1.5 AS wt FROM n UNION ALL SELECT p_partkey, w[1] || '_' || w[2], 1.0 FROM n)
  SELECT p_partkey, {SLOT.format('g', 4096)} AS slot, CAST(sum(wt) AS DOUBLE) AS value FROM g GROUP BY ALL""")
def _(t):
    w = t.part.select("p_partkey", F.split("p_name", " ").alias("w"))
    return E.hashed_bag(w, "p_partkey", [(F.col("w"), 1.5), (X.word_ngrams(F.col("w"), 2), 1.0)], 4096)


FIELDS = ["l_returnflag", "l_linestatus", "l_suppkey"]
TERMS = [f"'{c}_' || {c}" for c in FIELDS]


@query("e10_hashed_fields", f"SELECT {LINE}, [{', '.join([SLOT.format(x, 1 << 20) for x in TERMS] + [SLOT.format(f'{TERMS[i]} || $$_$$ || {TERMS[j]}', 1 << 20) for i in range(3) for j in range(i + 1, 3)])}] AS slots FROM lineitem")
def _(t):
    return line(t, E.hashed_fields(FIELDS, 1 << 20).alias("slots"))


@query("e11_drop_rare_terms", r"""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\pL\pN_][\pL\pN_]+')) AS term FROM documents)
  SELECT doc_id, count(*) AS n FROM w WHERE term IN (SELECT term FROM w GROUP BY 1 HAVING count(DISTINCT doc_id) >= 2) GROUP BY 1""")
def _(t):
    terms = t.documents.select("doc_id", F.explode(X.regex_words("text")).alias("term"))
    return E.drop_rare_terms(terms, "doc_id", "term").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


@query("e12_stacked_blocks", """WITH b AS (SELECT p_brand, row_number() OVER (ORDER BY p_brand) - 1 AS s FROM part GROUP BY 1),
  y AS (SELECT p_type, row_number() OVER (ORDER BY p_type) - 1 + (SELECT count(*) FROM b) AS s FROM part GROUP BY 1), n AS (SELECT count(*) + (SELECT count(*) FROM b) AS n FROM y)
  SELECT p_partkey, s AS slot, 1.0::DOUBLE AS value FROM part JOIN b USING (p_brand) UNION ALL SELECT p_partkey, s, 1.0 FROM part JOIN y USING (p_type)
  UNION ALL SELECT p_partkey, n, p_retailprice FROM part, n UNION ALL SELECT p_partkey, n + 1, CAST(p_size AS DOUBLE) FROM part, n""")
def _(t):
    hot_block = E.sparse_one_hot(t.part, "p_partkey", ["p_brand", "p_type"])
    return E.stacked_blocks([hot_block, E.numeric_block(t.part, "p_partkey", ["p_retailprice", "p_size"])])


@query("e13_formula_matrix", """WITH b AS (SELECT p_brand, row_number() OVER (ORDER BY p_brand) - 2 AS s FROM part GROUP BY 1), y AS (SELECT p_type, row_number() OVER (ORDER BY p_type) - 2 AS s FROM part GROUP BY 1)
  SELECT p_partkey, 0 AS slot, p_retailprice AS value FROM part UNION ALL SELECT p_partkey, 1, CAST(p_size AS DOUBLE) FROM part
  UNION ALL SELECT p_partkey, 2 + s, 1.0 FROM part JOIN b USING (p_brand) WHERE s >= 0
  UNION ALL SELECT p_partkey, 2 + s + (SELECT max(s) + 1 FROM b), 1.0 FROM part JOIN y USING (p_type) WHERE s >= 0""")
def _(t):
    return E.design_matrix(t.part, "p_partkey", ["p_retailprice", "p_size"], ["p_brand", "p_type"])


WIDE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("e15_robust_scaled", f"SELECT {LINE}, " + ", ".join(f"round(({c} - (SELECT median({c}) FROM lineitem)) / (SELECT quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) FROM lineitem), 6) AS {c}" for c in WIDE) + " FROM lineitem")
def _(t):
    return rounded(line(t, *E.robust_scaled(t.lineitem, WIDE)))


@query("e16_min_max_scaled", f"SELECT {LINE}, " + ", ".join(f"round(({c} - (SELECT min({c}) FROM lineitem)) / (SELECT max({c}) - min({c}) FROM lineitem), 6) AS {c}" for c in WIDE) + " FROM lineitem")
def _(t):
    return rounded(line(t, *E.min_max_scaled(t.lineitem, WIDE)))


def projection(t, matrix):
    v = t.embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    return v.select("vec_id", E.project(F.col("v"), matrix).alias("p"))


@query("e17_pca")
def _(t):
    return projection(t, E.pca_matrix(t.embeddings, "embedding", 12))


@query("e18_truncated_svd")
def _(t):
    return projection(t, E.svd_matrix(t.embeddings, "embedding", 12))


def projection_sql(matrix):
    dots = [f"round(list_dot_product(v, [{', '.join(repr(float(x)) for x in matrix[:, j])}]::DOUBLE[]), 5) + 0.0" for j in range(matrix.shape[1])]
    return f"[{', '.join(dots)}]"


@query("e19_random_projection", f"SELECT vec_id, {projection_sql(E.gaussian_matrix(64, 12, 7))} AS gaussian, {projection_sql(E.sparse_matrix(64, 12, 7))} AS sparse FROM (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings)")
def _(t):
    g = projection(t, E.gaussian_matrix(64, 12, 7)).withColumnRenamed("p", "gaussian")
    both = g.join(projection(t, E.sparse_matrix(64, 12, 7)).withColumnRenamed("p", "sparse"), "vec_id")
    return both.select("vec_id", *[F.transform(c, lambda x: F.round(x, 5) + F.lit(0.0)).alias(c) for c in ("gaussian", "sparse")])


@query("e20_item_vectors")
def _(t):
    baskets = basket_lines(t).groupBy("order_id").agg(F.sort_array(F.collect_set(F.col("product_id").cast("string"))).alias("items"))
    return E.item_vectors(baskets, "items")


@query("e21_leaf_indices")
def _(t):
    df = VectorAssembler(inputCols=["l_quantity", "l_discount", "l_tax"], outputCol="f").transform(t.lineitem)
    return E.leaf_indices(df, "f", "l_extendedprice").select(*IDS, "leaves")


@query("e22_log_counts", """WITH c AS (SELECT p_name || '/' || p_type AS cat, count(*) AS n FROM part GROUP BY 1), b AS (SELECT p_brand, count(*) AS n FROM part GROUP BY 1)
  SELECT p_partkey, round(ln(1 + CASE WHEN c.n >= 7 THEN c.n ELSE (SELECT sum(n) FROM c WHERE n < 7) END), 6) AS type_count, round(ln(1 + b.n), 6) AS brand_count, CAST(length(p_name) AS INT) AS len
  FROM part JOIN c ON c.cat = p_name || '/' || p_type JOIN b USING (p_brand)""")
def _(t):
    df = t.part.withColumn("cat", F.concat_ws("/", "p_name", "p_type"))
    types = supported_ids(df, "cat", 7, 2, 1).select("cat", F.col("n").alias("tn"))
    brands = supported_ids(df, "p_brand", 5, 1, 0).select("p_brand", F.col("n").alias("bn"))
    return rounded(df.join(types, "cat").join(brands, "p_brand").select(
        "p_partkey", F.log1p("tn").alias("type_count"), F.log1p("bn").alias("brand_count"), F.length("p_name").alias("len")))


@query("e23_interactions", f"SELECT {LINE}, [l_quantity * l_discount, l_quantity * l_tax, l_discount * l_tax] AS v FROM lineitem")
def _(t):
    return E.interactions(t.lineitem, ["l_quantity", "l_discount", "l_tax"], "x").select(*IDS, vector_to_array("x").alias("v"))


def listings(t):
    return t.part.select(
        "p_partkey", F.col("p_name").alias("name"), F.when(F.col("p_partkey") % 3 != 0, F.col("p_brand")).alias("brand"),
        F.concat_ws("/", "p_type", "p_brand", F.col("p_size").cast("string")).alias("category"), (F.col("p_size") % 5).cast("string").alias("condition"),
        F.when(F.col("p_size") % 7 == 0, "No description yet").otherwise(F.concat_ws(" ", "p_type", "p_name", "p_brand")).alias("description"),
        F.log1p("p_retailprice").alias("price"))


def _normal(c):
    return f"list_filter(string_split(regexp_replace(lower({c}), '[^a-z0-9]', ' ', 'g'), ' '), lambda w: length(w) > 1 AND NOT list_contains({STOP}, w))"


def _gram_rows(c, sizes):
    return " UNION ALL ".join(
        f"SELECT p_partkey, {n} AS n, unnest(list_transform(range(1, greatest(CAST(len({c}) AS INT) - {n - 2}, 1)), lambda i: array_to_string({c}[i:i + {n - 1}], ' '))) AS gram FROM ls" for n in sizes)


FIELD_NAMES = ["brand", "general_cat", "subcat_1", "subcat_2", "condition"]


@query("f22_listing_matrix", f"""WITH ls AS (SELECT p_partkey, CASE WHEN p_partkey % 3 <> 0 THEN p_brand ELSE 'missing' END AS brand, p_type AS general_cat, p_brand AS subcat_1, CAST(p_size AS VARCHAR) AS subcat_2,
    CAST(p_size % 5 AS VARCHAR) AS condition, {_normal('p_name')} AS nw, {_normal("CASE WHEN p_size % 7 = 0 THEN 'missing' ELSE concat_ws(' ', p_type, p_name, p_brand) END")} AS dw FROM part),
  hot AS ({" UNION ALL ".join(f"SELECT p_partkey, {i} AS field, {c} AS term FROM ls" for i, c in enumerate(FIELD_NAMES))}),
  hs AS (SELECT field, term, row_number() OVER (ORDER BY field, term) - 1 AS slot FROM hot GROUP BY field, term),
  ng AS ({_gram_rows('nw', (1, 2))}), ns AS (SELECT n, gram, row_number() OVER (ORDER BY n, gram) - 1 + (SELECT count(*) FROM hs) AS slot FROM ng GROUP BY n, gram HAVING count(DISTINCT p_partkey) >= 2),
  dg AS ({_gram_rows('dw', (1, 2, 3))}), tf AS (SELECT p_partkey, gram, count(*) AS tf FROM dg GROUP BY ALL),
  df AS (SELECT gram, count(*) AS df, sum(tf) AS total FROM tf GROUP BY 1 ORDER BY total DESC, gram LIMIT 50000),
  wt AS (SELECT p_partkey, gram, tf * (ln((1 + (SELECT count(DISTINCT p_partkey) FROM dg)) / (1 + df)) + 1) AS w FROM tf JOIN df USING (gram)),
  ds AS (SELECT gram, row_number() OVER (ORDER BY gram) - 1 + (SELECT count(*) FROM hs) + (SELECT count(*) FROM ns) AS slot FROM df)
  SELECT p_partkey, slot, 1.0::DOUBLE AS value FROM hot JOIN hs USING (field, term)
  UNION ALL SELECT p_partkey, slot, CAST(count(*) AS DOUBLE) FROM ng JOIN ns USING (n, gram) GROUP BY ALL
  UNION ALL SELECT p_partkey, slot, round(w / sqrt(sum(w * w) OVER (PARTITION BY p_partkey)), 6) FROM wt JOIN ds USING (gram)""")
def _(t):
    return rounded(P.listing_cells(P.prepared_listings(listings(t)), "p_partkey"))


@query("f26_projected_rows")
def _(t):
    df = t.embeddings.withColumn("kind", F.concat(F.lit("k"), "label"))
    return P.projected_rows(df, "vec_id", "embedding", ["kind"])
