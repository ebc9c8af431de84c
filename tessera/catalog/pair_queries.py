"""Text-pair and vector similarity (S1-S21) and the pair tables."""

from pyspark.sql import functions as F

from tessera.catalog.base import query
from tessera.catalog.panel import part_pairs
from tessera.catalog.relational_queries import EDGES
from tessera.functions import pairs as S
from tessera.functions import rules
from tessera.functions import text as X
from tessera.operators import similarity as M
from tessera.operators.frames import rounded
from tessera.operators.graph import core_numbers
from tessera.operators.joins import common_neighbours
from tessera.plans import pairs as P
from tessera.session import cut_lineage

STOP_WORDS = rules.QUESTION_STOP_WORDS
STOP = "[" + ", ".join(f"'{w}'" for w in STOP_WORDS) + "]"


def pairs(t):
    """Each conversation turn with the next one: (id, conv_id, turn, a, b, label)."""
    one = t.conversations.select("conv_id", "turn", F.col("text").alias("a"))
    two = t.conversations.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("b"), (F.col("role") == "user").cast("int").alias("label"))
    return one.join(two, ["conv_id", "turn"]).withColumn("id", F.concat_ws("-", "conv_id", "turn"))


PAIRS = """pr AS (SELECT p.conv_id || '-' || p.turn AS id, p.text AS a, q.text AS b, CAST(q.role = 'user' AS INT) AS label FROM conversations p JOIN conversations q ON p.conv_id = q.conv_id AND q.turn = p.turn + 1)"""
WORDS = r"""{p}, wd AS (SELECT id, list_filter(regexp_split_to_array(lower(a), '\s+'), lambda w: w <> '') AS x, list_filter(regexp_split_to_array(lower(b), '\s+'), lambda w: w <> '') AS y FROM pr)""".format(p=PAIRS)


def words(t):
    return pairs(t).select("id", X.space_words(F.lower("a")).alias("x"), X.space_words(F.lower("b")).alias("y"))


def no_stop(c):
    return f"list_filter(list_distinct({c}), lambda w: NOT list_contains({STOP}, w))"


SHARE = f"""CASE WHEN len({no_stop('x')}) = 0 OR len({no_stop('y')}) = 0 THEN 0.0 ELSE round(2 * len(list_intersect({no_stop('x')}, {no_stop('y')})) / (len({no_stop('x')}) + len({no_stop('y')})), 6) END"""


@query("s01_shared_word_share", f"WITH {WORDS} SELECT id, CAST({SHARE} AS DOUBLE) AS share FROM wd")
def _(t):
    return rounded(words(t).select("id", S.shared_share(F.col("x"), F.col("y"), STOP_WORDS).alias("share")))


GRAMS = """gr AS (SELECT id, gram, CAST(sum(l) AS BIGINT) AS ca, CAST(sum(1 - l) AS BIGINT) AS cb FROM (SELECT id, unnest(x) AS gram, 1 AS l FROM wd UNION ALL SELECT id, unnest(y), 0 FROM wd) GROUP BY ALL),
  wt AS (SELECT gram, CASE WHEN sum(ca + cb) < 2 THEN 0.0 ELSE 1 / (sum(ca + cb) + 10000) END AS weight FROM gr GROUP BY 1)"""


def weighted_sql(where):
    return f"""SELECT id, round(CASE WHEN max(ca) = 0 OR max(cb) = 0 THEN 0.0 ELSE 2 * sum(CASE WHEN ca > 0 AND cb > 0 THEN weight ELSE 0 END) / nullif(sum(weight * (CAST(ca > 0 AS INT) + CAST(cb > 0 AS INT))), 0) END, 6) AS share
      FROM gr JOIN wt USING (gram) WHERE {where} GROUP BY 1"""


@query("s02_weighted_share", f"WITH {WORDS}, {GRAMS} SELECT a.id, a.share AS plain, b.share AS no_stop FROM ({weighted_sql('true')}) a LEFT JOIN ({weighted_sql(f'NOT list_contains({STOP}, gram)')}) b USING (id)")
def _(t):
    g = M.pair_grams(words(t), "id", F.col("x"), F.col("y"))
    w = M.inverse_weights(g)
    plain = M.weighted_share(g, "id", w).withColumnRenamed("share", "plain")
    return rounded(plain.join(M.weighted_share(g, "id", w, STOP_WORDS).withColumnRenamed("share", "no_stop"), "id", "left"))


def ratio_sql(n1, n2):
    return f"round(CASE WHEN {n2} = 0 THEN NULL WHEN {n1} = 0 THEN 0.0 ELSE {n2} / {n1} END, 6)"


def chars(c):
    return f"length(array_to_string({c}, ''))"


UX, UY, SX, SY = "list_distinct(x)", "list_distinct(y)", no_stop("x"), no_stop("y")
OVERLAP = {
    "common_words": "len(list_intersect(x, y))",
    "total_unique_words": "len(list_distinct(list_concat(x, y)))",
    "total_unique_words_stop": f"len({no_stop('list_concat(x, y)')})",
    "same_start_word": "x[1] = y[1]",
    "wc_diff": "abs(len(x) - len(y))",
    "wc_unique_diff": f"abs(len({UX}) - len({UY}))",
    "wc_unique_stop_diff": f"abs(len({SX}) - len({SY}))",
    "char_diff": f"abs({chars('x')} - {chars('y')})",
    "char_diff_unique_stop": f"abs({chars(SX)} - {chars(SY)})",
}
RATIOS = {
    "wc_ratio": ratio_sql("len(x)", "len(y)"),
    "wc_unique_ratio": ratio_sql(f"len({UX})", f"len({UY})"),
    "wc_unique_stop_ratio": ratio_sql(f"len({SX})", f"len({SY})"),
    "char_ratio": ratio_sql(chars("x"), chars("y")),
}


def overlap_sql(names):
    return ", ".join(f"CAST({OVERLAP[n]} AS INT) AS {n}" if n in OVERLAP else f"CAST({RATIOS[n]} AS DOUBLE) AS {n}" for n in names)


def overlap_query(t, names):
    f = S.overlap_features(F.col("x"), F.col("y"), STOP_WORDS)
    return rounded(words(t).select("id", *[f[n].alias(n) for n in names]))


COMMON = ["common_words", "total_unique_words", "total_unique_words_stop"]
DIFFS = ["wc_diff", "wc_unique_diff", "wc_unique_stop_diff", "char_diff", "char_diff_unique_stop", *RATIOS]


@query("s03_common_words", f"WITH {WORDS} SELECT id, {overlap_sql(COMMON)} FROM wd")
def _(t):
    return overlap_query(t, COMMON)


@query("s04_count_differences", f"WITH {WORDS} SELECT id, {overlap_sql(DIFFS)} FROM wd")
def _(t):
    return overlap_query(t, DIFFS)


@query("s05_same_first_word", f"WITH {WORDS} SELECT id, {overlap_sql(['same_start_word'])} FROM wd")
def _(t):
    return overlap_query(t, ["same_start_word"])


def ngram_sql(c, n):
    if n == 1:
        return c
    return f"list_transform(range(1, greatest(CAST(len({c}) AS INT) - {n - 2}, 1)), lambda i: array_to_string({c}[i:i + {n - 1}], '_'))"


TOKENS = PAIRS + r""", tk AS (SELECT id, regexp_extract_all(lower(a), '[\pL\pN_][\pL\pN_]+') AS a1, regexp_extract_all(lower(b), '[\pL\pN_][\pL\pN_]+') AS b1,
  list_filter(regexp_split_to_array(a, '\s+'), lambda w: w <> '') AS aw, list_filter(regexp_split_to_array(b, '\s+'), lambda w: w <> '') AS bw FROM pr),
  ng AS (SELECT id, a1, b1, """ + ", ".join(f"{ngram_sql(s + 'w', n)} AS {s}{n}" for s in "ab" for n in (2, 3)) + " FROM tk)"


def div(x, y):
    return f"round(coalesce({x} / nullif({y}, 0), 0), 6)"


def jac(n):
    return div(f"len(list_intersect(a{n}, b{n}))", f"len(list_distinct(list_concat(a{n}, b{n})))")


def dic(n):
    return div(f"2 * len(list_intersect(a{n}, b{n}))", f"(len(list_distinct(a{n})) + len(list_distinct(b{n})))")


@query("s06_jaccard", f"WITH {TOKENS} SELECT id, {', '.join(f'{jac(n)} AS jaccard_{n}' for n in (1, 2, 3))} FROM ng")
def _(t):
    return rounded(P.gram_table(pairs(t), "id")).select("id", "jaccard_1", "jaccard_2", "jaccard_3")


@query("s07_dice", f"WITH {TOKENS} SELECT id, {', '.join(f'{dic(n)} AS dice_{n}' for n in (1, 2, 3))} FROM ng")
def _(t):
    return rounded(P.gram_table(pairs(t), "id")).select("id", "dice_1", "dice_2", "dice_3")


def found(s, o, n):
    return f"len(list_filter({s}{n}, lambda g: list_contains({o}{n}, g)))"


def found_sql(n):
    cols = []
    for s, o in ("ab", "ba"):
        cols += [f"CAST({found(s, o, n)} AS INT) AS {s}{n}_in_{o}", f"{div(found(s, o, n), f'len({s}{n})')} AS ratio_{s}{n}_in_{o}"]
    return cols + [f"{div(found('b', 'a', n), f'len(a{n})')} AS b{n}_in_a_per_a", f"{div(found('b', 'a', n), found('a', 'b', n))} AS b{n}_in_a_per_a_in_b"]


FOUND = [f"{s}{n}_in_{o}" for n in (1, 2, 3) for s, o in ("ab", "ba")]


@query("s08_grams_found", f"WITH {TOKENS} SELECT id, {', '.join(c for n in (1, 2, 3) for c in found_sql(n))} FROM ng")
def _(t):
    g = rounded(P.gram_table(pairs(t), "id"))
    names = [c for n in (1, 2, 3) for c in (f"a{n}_in_b", f"ratio_a{n}_in_b", f"b{n}_in_a", f"ratio_b{n}_in_a", f"b{n}_in_a_per_a", f"b{n}_in_a_per_a_in_b")]
    return g.select("id", *names)


STATS = {"mean": "list_avg", "std": "list_stddev_pop", "min": "list_min", "max": "list_max", "median": "list_median"}


def position_cte():
    cols = []
    for n in (1, 2, 3):
        for s, o in ("ab", "ba"):
            p = f"list_filter(list_transform({s}{n}, lambda g, i: CASE WHEN list_contains({o}{n}, g) THEN i END), lambda p: p IS NOT NULL)"
            cols.append(f"CASE WHEN len({p}) = 0 THEN [0] ELSE {p} END AS p{s}{n}")
    return f"ps AS (SELECT *, {', '.join(cols)} FROM ng)"


def position_sql():
    return [x for n in (1, 2, 3) for s in "ab" for k, f in STATS.items() for x in (
        f"round(CAST({f}(p{s}{n}) AS DOUBLE), 6) AS pos_{s}{n}_{k}", f"{div(f'{f}(p{s}{n})', f'len({s}{n})')} AS norm_pos_{s}{n}_{k}")]


@query("s09_gram_positions", f"WITH {TOKENS}, {position_cte()} SELECT id, {', '.join(position_sql())} FROM ps")
def _(t):
    g = rounded(P.gram_table(pairs(t), "id"))
    return g.select("id", *[c for c in g.columns if c.startswith(("pos_", "norm_pos_"))])


def char_grams_sql(n, name):
    g = lambda c: f"unnest(list_transform(range(1, greatest(length({c}) - {n - 2}, 1)), lambda i: substr({c}, i, {n})))"
    return f"{name} AS (SELECT id, gram, CAST(sum(l) AS BIGINT) AS ca, CAST(sum(1 - l) AS BIGINT) AS cb FROM (SELECT id, {g('a')} AS gram, 1 AS l FROM pr UNION ALL SELECT id, {g('b')}, 0 FROM pr) GROUP BY ALL)"


def char_overlap_sql(g, p=""):
    return f"""SELECT id, round(count(*) FILTER (ca > 0 AND cb > 0) / count(*), 6) AS {p}jaccard, round(sum(least(ca, cb)) / sum(ca + cb), 6) AS {p}all_jaccard,
      round(sum(least(ca, cb)) / sum(greatest(ca, cb)), 6) AS {p}all_jaccard_max FROM {g} GROUP BY 1"""


def char_distance_sql(g, p=""):
    return f"""SELECT id, round(1 - sum(x * y) / (sqrt(sum(x * x)) * sqrt(sum(y * y))), 5) AS {p}tfidf_cosine,
      round(sqrt(greatest(2 - 2 * sum(x * y) / (sqrt(sum(x * x)) * sqrt(sum(y * y))), 0)), 5) AS {p}tfidf_l2_euclidean,
      round(sqrt(greatest(sum(x * x) / sum(x) ** 2 + sum(y * y) / sum(y) ** 2 - 2 * sum(x * y) / (sum(x) * sum(y)), 0)), 5) AS {p}tfidf_l1_euclidean,
      round(sqrt(greatest(2 - 2 * sum(ca * cb) / (sqrt(sum(ca * ca)) * sqrt(sum(cb * cb))), 0)), 5) AS {p}tf_l2_euclidean
      FROM (SELECT id, ca, cb, ca * idf AS x, cb * idf AS y FROM {g} JOIN (SELECT gram, ln((1 + 2 * (SELECT count(*) FROM pr)) / (1 + count(*) FILTER (ca > 0) + count(*) FILTER (cb > 0))) + 1 AS idf FROM {g} GROUP BY 1) USING (gram)) GROUP BY 1"""


def char_pairs(t, n):
    p = pairs(t)
    return p, M.pair_grams(p, "id", X.char_ngrams("a", n), X.char_ngrams("b", n))


@query("s10_char_gram_jaccard", f"WITH {PAIRS}, {char_grams_sql(2, 'g2')} {char_overlap_sql('g2')}")
def _(t):
    return rounded(M.gram_overlap(char_pairs(t, 2)[1], "id"))


@query("s11_tfidf_cosine", f"WITH {PAIRS}, {char_grams_sql(3, 'g3')} SELECT id, tfidf_cosine FROM ({char_distance_sql('g3')})")
def _(t):
    p, g = char_pairs(t, 3)
    return rounded(M.gram_distances(g, "id", p.agg(2 * F.count(F.lit(1))).scalar()).select("id", "tfidf_cosine"), 5)


@query("s12_tfidf_euclidean", f"WITH {PAIRS}, {char_grams_sql(1, 'g1')} SELECT id, tfidf_l2_euclidean, tfidf_l1_euclidean, tf_l2_euclidean FROM ({char_distance_sql('g1')})")
def _(t):
    p, g = char_pairs(t, 1)
    return rounded(M.gram_distances(g, "id", p.agg(2 * F.count(F.lit(1))).scalar()).drop("tfidf_cosine"), 5)


@query("s13_vector_distances", """WITH v AS (SELECT a.vec_id, unnest(a.embedding)::DOUBLE AS x, unnest(b.embedding)::DOUBLE AS y FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)
  SELECT vec_id, round(sum(abs(x - y)), 5) AS cityblock, round(sum(coalesce(abs(x - y) / nullif(abs(x) + abs(y), 0), 0)), 5) AS canberra, round(sqrt(sum((x - y) ** 2)), 5) AS euclidean,
  round(cbrt(sum(abs(x - y) ** 3)), 5) AS minkowski3, round(sum(abs(x - y)) / sum(abs(x + y)), 5) AS braycurtis FROM v GROUP BY 1""")
def _(t):
    nxt = t.embeddings.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("y"))
    both = t.embeddings.select("vec_id", F.col("embedding").alias("x")).join(nxt, "vec_id")
    return rounded(both.select("vec_id", *[c.alias(n) for n, c in S.vector_distances(F.col("x"), F.col("y")).items()]), 5)


WORD_VECTORS = """ww AS (SELECT id, 'a' AS s, unnest(regexp_extract_all(lower(a), '[\\pL\\pN]+')) AS word FROM pr UNION ALL SELECT id, 'b', unnest(regexp_extract_all(lower(b), '[\\pL\\pN]+')) FROM pr),
  wv AS (SELECT word, embedding AS vector FROM (SELECT DISTINCT word, (ascii(word) * 131 + ascii(substr(word, 2, 1)) * 17 + length(word) * 7) % (SELECT count(*) FROM embeddings) AS vec_id FROM ww) JOIN embeddings USING (vec_id))"""


def word_vectors(t, p):
    """Vectors for the words of the pairs: an embedding picked by the word's letters and length."""
    w = p.select(F.explode(F.concat(X.letter_words("a"), X.letter_words("b"))).alias("word")).distinct()
    n = t.embeddings.agg(F.count(F.lit(1))).scalar()
    at = (F.ascii("word") * 131 + F.ascii(F.substring("word", 2, 1)) * 17 + F.length("word") * 7) % n
    return w.withColumn("vec_id", at).join(t.embeddings, "vec_id").select("word", F.col("embedding").alias("vector"))


SENT = f"""{PAIRS}, {WORD_VECTORS}, sv AS (SELECT id, s, pos, sum(v) AS v FROM (SELECT id, s, unnest(vector)::DOUBLE AS v, generate_subscripts(vector, 1) AS pos FROM ww JOIN wv USING (word)) GROUP BY ALL),
  un AS (SELECT id, s, pos, v / sqrt(sum(v * v) OVER (PARTITION BY id, s)) AS v FROM sv)"""


@query("s14_sentence_vectors", f"WITH {SENT} SELECT id, list(round(v, 5) + 0.0 ORDER BY pos) AS vector FROM un WHERE s = 'a' GROUP BY 1")
def _(t):
    p = cut_lineage(pairs(t).select("id", "a", "b"))
    v = M.sentence_vectors(p, "id", word_vectors(t, p), {"vector": X.letter_words("a")}).where("vector is not null")
    return v.select("id", F.transform("vector", lambda x: F.round(x, 5) + F.lit(0.0)).alias("vector"))


# the SQL dialect counts edits in bytes: letters beyond ASCII become one question mark, on both sides
def one_byte_words(c):
    return F.transform(X.letter_words(c), lambda w: F.regexp_replace(w, r"[^\x00-\x7F]", "?"))


def one_byte_sql(c):
    return rf"list_transform(regexp_extract_all(lower({c}), '[\pL\pN]+'), lambda w: regexp_replace(w, '[^\x00-\x7F]', '?', 'g'))"


RATIO_CTE = PAIRS + """, tk AS (SELECT id, """ + one_byte_sql("a") + """ AS x, """ + one_byte_sql("b") + """ AS y FROM pr),
  st AS (SELECT *, list_sort(list_intersect(x, y)) AS c, list_sort(list_distinct(list_filter(x, lambda w: NOT list_contains(y, w)))) AS dx, list_sort(list_distinct(list_filter(y, lambda w: NOT list_contains(x, w)))) AS dy FROM tk),
  tx AS (SELECT id, array_to_string(x, ' ') AS px, array_to_string(y, ' ') AS py, array_to_string(list_sort(x), ' ') AS sx, array_to_string(list_sort(y), ' ') AS sy, array_to_string(c, ' ') AS c,
    array_to_string(list_concat(c, dx), ' ') AS cx, array_to_string(list_concat(c, dy), ' ') AS cy FROM st)"""


def edit_sql(a, b):
    return f"coalesce(1 - levenshtein({a}, {b}) / nullif(greatest(length({a}), length({b})), 0), 1.0)"


RATIO_SQL = f"round({edit_sql('px', 'py')}, 6) AS plain, round({edit_sql('sx', 'sy')}, 6) AS token_sort, round(greatest({edit_sql('c', 'cx')}, {edit_sql('c', 'cy')}, {edit_sql('cx', 'cy')}), 6) AS token_set"


@query("s15_text_ratios", f"WITH {RATIO_CTE} SELECT id, {RATIO_SQL} FROM tx")
def _(t):
    w = pairs(t).select("id", one_byte_words("a").alias("x"), one_byte_words("b").alias("y"))
    return rounded(w.select("id", *[c.alias(n) for n, c in S.text_ratios(F.col("x"), F.col("y")).items()]))


@query("s16_pair_degrees", f"WITH {EDGES}, f AS (SELECT n, count(*) AS f FROM (SELECT a AS n FROM e0 UNION ALL SELECT b FROM e0) GROUP BY 1) SELECT a, b, x.f AS a_freq, y.f AS b_freq FROM e0 JOIN f x ON a = x.n JOIN f y ON b = y.n")
def _(t):
    return M.pair_degrees(part_pairs(t), "a", "b")


@query("s17_shared_neighbours", f"""WITH {EDGES}, dg AS (SELECT src, count(*) AS d FROM adj GROUP BY 1) SELECT a, b, coalesce(c, 0) AS common, round(coalesce(c, 0) / least(x.d, y.d), 6) AS share FROM e0 LEFT JOIN
  (SELECT a, b, count(*) c FROM e0 JOIN adj x ON x.src = a JOIN adj y ON y.src = b AND x.dst = y.dst GROUP BY ALL) USING (a, b) JOIN dg x ON x.src = a JOIN dg y ON y.src = b""")
def _(t):
    from tessera.operators.joins import undirected
    p = part_pairs(t)
    deg = undirected(p, "a", "b").groupBy("src").agg(F.count(F.lit(1)).alias("d"))
    c = common_neighbours(p, "a", "b").join(deg.select(F.col("src").alias("a"), F.col("d").alias("da")), "a").join(deg.select(F.col("src").alias("b"), F.col("d").alias("db")), "b")
    return rounded(c.select("a", "b", "common", (F.col("common") / F.least("da", "db")).alias("share")))


@query("s18_core_numbers")
def _(t):
    return core_numbers(part_pairs(t), "a", "b")


@query("s19_word_grid", f"""WITH {PAIRS}, {WORD_VECTORS}, dn AS (SELECT word, count(DISTINCT (id, s)) AS n FROM ww GROUP BY 1), ii AS (SELECT word, ln((1 + 2 * (SELECT count(*) FROM pr)) / (1 + n)) + 1 AS idf FROM dn),
  x AS (SELECT id, unnest(regexp_extract_all(lower(a), '[\\pL\\pN]+')[1:10]) AS word, generate_subscripts(regexp_extract_all(lower(a), '[\\pL\\pN]+')[1:10], 1) AS p FROM pr),
  y AS (SELECT id, unnest(regexp_extract_all(lower(b), '[\\pL\\pN]+')[1:10]) AS word, generate_subscripts(regexp_extract_all(lower(b), '[\\pL\\pN]+')[1:10], 1) AS q FROM pr),
  c AS (SELECT x.id, (p - 1) * 10 + q - 1 AS at, list_cosine_similarity(v.vector::DOUBLE[], w.vector::DOUBLE[]) * i.idf * j.idf AS v FROM x JOIN wv v USING (word) JOIN ii i ON i.word = x.word JOIN y ON x.id = y.id JOIN wv w ON w.word = y.word JOIN ii j ON j.word = y.word)
  SELECT id, round(sum(v), 4) AS total, round(max(v), 4) AS best, count(*) AS cells FROM c GROUP BY 1""")
def _(t):
    p = pairs(t)
    sides = p.select(F.concat(F.array_distinct(X.letter_words("a")), F.array_distinct(X.letter_words("b"))).alias("w"))
    n = p.agg(2 * F.count(F.lit(1))).scalar()
    idf = sides.select(F.explode("w").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")).select("word", (F.log((1 + n) / (1 + F.col("n"))) + 1).alias("idf"))
    grid = M.word_grid(p.select("id", X.letter_words("a").alias("a"), X.letter_words("b").alias("b")), "id", word_vectors(t, p), idf)
    return rounded(grid.select("id", F.explode("grid").alias("v")).groupBy("id").agg(
        F.sum("v").alias("total"), F.max(F.when(F.col("v") != 0, F.col("v"))).alias("best"), F.count_if(F.col("v") != 0).alias("cells")).where("cells > 0"), 4)


LENGTHS = """CAST(length(a) - length(b) AS INT) AS diff_len, CAST(abs(length(a) - length(b)) AS INT) AS abs_diff_len, round(ln(1 + abs(length(a) - length(b))), 6) AS log_abs_diff_len,
  round(greatest(length(a), 1) / greatest(length(b), 1), 6) AS ratio_len, round(ln(1 + greatest(length(a), 1) / greatest(length(b), 1)), 6) AS log_ratio_len"""


@query("s20_lengths", f"WITH {PAIRS} SELECT id, {LENGTHS} FROM pr")
def _(t):
    return rounded(pairs(t).select("id", *[c.alias(n) for n, c in S.length_features(F.col("a"), F.col("b")).items()]))


PAIR_ENDS = """ed AS (SELECT p.conv_id || '-' || p.turn AS id, md5(p.text) AS na, md5(q.text) AS nb FROM conversations p JOIN conversations q ON p.conv_id = q.conv_id AND q.turn = p.turn + 1),
  fr AS (SELECT n, count(*) AS f FROM (SELECT na AS n FROM ed UNION ALL SELECT nb FROM ed) GROUP BY 1),
  nb AS (SELECT DISTINCT na AS src, nb AS dst FROM ed WHERE na <> nb UNION SELECT DISTINCT nb, na FROM ed WHERE na <> nb),
  cm AS (SELECT na, nb, count(*) AS common FROM (SELECT DISTINCT na, nb FROM ed) JOIN nb x ON x.src = na JOIN nb y ON y.src = nb AND x.dst = y.dst GROUP BY ALL),
  ends AS (SELECT id, x.f AS a_freq, y.f AS b_freq, coalesce(common, 0) AS common FROM ed JOIN fr x ON x.n = na JOIN fr y ON y.n = nb LEFT JOIN cm USING (na, nb))"""


@query("f18_pair_overlap", f"""WITH {WORDS}, {GRAMS}, {PAIR_ENDS} SELECT id, a_freq, b_freq, common, CAST({SHARE} AS DOUBLE) AS word_match, {overlap_sql([*OVERLAP, *RATIOS])}, a.share AS tfidf_wm, b.share AS tfidf_wm_stops FROM wd
  LEFT JOIN ({weighted_sql('true')}) a USING (id) LEFT JOIN ({weighted_sql(f'NOT list_contains({STOP}, gram)')}) b USING (id) JOIN ends USING (id)""")
def _(t):
    p = pairs(t).withColumn("na", F.md5("a")).withColumn("nb", F.md5("b"))
    return rounded(P.overlap_table(p, "id", STOP_WORDS, ("na", "nb")))


def gram_counts_sql():
    out = []
    for n in (1, 2, 3):
        for s in "ab":
            out += [f"CAST(len({s}{n}) AS INT) AS count_{s}{n}", f"CAST(len(list_distinct({s}{n})) AS INT) AS unique_{s}{n}", f"{div(f'len(list_distinct({s}{n}))', f'len({s}{n})')} AS unique_ratio_{s}{n}"]
        out += found_sql(n) + [f"{jac(n)} AS jaccard_{n}", f"{dic(n)} AS dice_{n}"]
    for s in "ab":
        d = f"len(list_filter({s}1, lambda x: regexp_full_match(x, '[0-9]+')))"
        out += [f"CAST({d} AS INT) AS digits_{s}", f"{div(d, f'len({s}1)')} AS digit_ratio_{s}"]
    return out + position_sql()


@query("f19_pair_grams", f"WITH {TOKENS}, {position_cte()} SELECT id, {', '.join(gram_counts_sql())} FROM ps")
def _(t):
    return rounded(P.gram_table(pairs(t), "id"))


@query("f20_pair_characters", f"WITH {PAIRS}, {', '.join(char_grams_sql(n, f'g{n}') for n in (1, 2, 3))} SELECT id, {LENGTHS}, round(least(greatest(length(a), 1) / greatest(length(b), 1), (SELECT max(greatest(length(a), 1) / greatest(length(b), 1)) + 2 * stddev_samp(greatest(length(a), 1) / greatest(length(b), 1)) FROM pr WHERE label = 1)), 6) AS ratio_len_capped, o1.* EXCLUDE (id), o2.* EXCLUDE (id), o3.* EXCLUDE (id), d1.* EXCLUDE (id), d2.* EXCLUDE (id), d3.* EXCLUDE (id) FROM pr "
       + " ".join(f"LEFT JOIN ({char_overlap_sql(f'g{n}', f'g{n}_')}) o{n} USING (id) LEFT JOIN ({char_distance_sql(f'g{n}', f'g{n}_')}) d{n} USING (id)" for n in (1, 2, 3)))
def _(t):
    out = P.char_table(pairs(t), "id", "label")
    far = [c for c in out.columns if c.endswith(("cosine", "euclidean"))]
    return rounded(rounded(out, 5, far), 6)


@query("f21_pair_vectors", f"""WITH {SENT}, m AS (SELECT id, s, avg(v) AS mu FROM un GROUP BY ALL),
  sh AS (SELECT id, s, avg((v - mu) ** 3) / avg((v - mu) ** 2) ** 1.5 AS skew, avg((v - mu) ** 4) / avg((v - mu) ** 2) ** 2 - 3 AS kurt FROM un JOIN m USING (id, s) GROUP BY ALL),
  ds AS (SELECT x.id, sum(abs(x.v - y.v)) AS cityblock, sum(coalesce(abs(x.v - y.v) / nullif(abs(x.v) + abs(y.v), 0), 0)) AS canberra, sqrt(sum((x.v - y.v) ** 2)) AS euclidean, cbrt(sum(abs(x.v - y.v) ** 3)) AS minkowski3,
    sum(abs(x.v - y.v)) / sum(abs(x.v + y.v)) AS braycurtis FROM un x JOIN un y ON x.id = y.id AND x.pos = y.pos AND x.s = 'a' AND y.s = 'b' GROUP BY 1),
  {RATIO_CTE.split(', ', 1)[1][RATIO_CTE.split(', ', 1)[1].index('tk AS'):]}
  SELECT tx.id, {RATIO_SQL.replace(', 6)', ', 4)')}, round(cityblock, 4) AS cityblock, round(canberra, 4) AS canberra, round(euclidean, 4) AS euclidean, round(minkowski3, 4) AS minkowski3, round(braycurtis, 4) AS braycurtis,
    round(p.skew, 4) AS skew_a, round(p.kurt, 4) AS kurtosis_a, round(q.skew, 4) AS skew_b, round(q.kurt, 4) AS kurtosis_b
  FROM tx LEFT JOIN ds ON tx.id = ds.id LEFT JOIN sh p ON p.id = tx.id AND p.s = 'a' LEFT JOIN sh q ON q.id = tx.id AND q.s = 'b'""")
def _(t):
    p = cut_lineage(pairs(t).select("id", "a", "b"))
    return rounded(P.vector_table(p, "id", word_vectors(t, p), one_byte_words), 4)


@query("s21_nearest_neighbours", """WITH e AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
  d AS (SELECT a.vec_id AS q, b.vec_id AS t, any_value(b.label) AS label, sum(abs(a.x - b.x)) AS d FROM e a JOIN e b ON a.i = b.i AND a.vec_id <> b.vec_id GROUP BY ALL),
  k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY d, t) r FROM d) WHERE r <= 15),
  v AS (SELECT q, label, row_number() OVER (PARTITION BY q ORDER BY count(*) DESC, label) r FROM k GROUP BY q, label)
  SELECT v.q AS qid, v.label AS vote, round(avg(k.label), 6) AS mean, round(max(k.d), 5) AS farthest FROM v JOIN k USING (q) WHERE v.r = 1 GROUP BY ALL""")
def _(t):
    from tessera.operators.neighbours import nearest, vote
    v = t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    found = nearest(v, v, 15, skip_same_id=True)
    far = found.groupBy("qid").agg(F.max("distance").alias("farthest"))
    votes = vote(found, t.embeddings.select(F.col("vec_id").alias("id"), "label"), "label")
    return rounded(rounded(votes.join(far, "qid"), 5, ["farthest"]))
