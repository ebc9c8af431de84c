"""Text operators (X1-X30) and the comment tables."""

from pyspark.sql import functions as F

from tessera.catalog.base import query
from tessera.functions import rules
from tessera.functions import text as X
from tessera.operators import vocabulary as V
from tessera.operators.aggregates import log_count_ratio
from tessera.operators.frames import rounded
from tessera.operators.ranges import dense_codes
from tessera.session import cut_lineage
from tessera.sources.writers import svmlight_lines


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def fold(expr: str, pairs) -> str:
    for pattern, repl in pairs:
        if r"\b" in pattern:  # the dialect's boundaries are ASCII ones: match the neighbours, twice for shared ones
            word = pattern.replace(r"\b", "")
            once = lit(rf"(^|[^\pL\pN_])({word})($|[^\pL\pN_])")
            for _ in range(2):
                expr = f"regexp_replace({expr}, {once}, {lit(chr(92) + '1' + repl + chr(92) + '3')}, 'g')"
            continue
        expr = f"regexp_replace({expr}, {lit(pattern)}, {lit(repl.replace('$1', chr(92) + '1'))}, 'g')"
    return expr


def words_sql(expr: str) -> str:
    return rf"list_filter(regexp_split_to_array({expr}, '\s+'), lambda w: w <> '')"


PUNCT = X.PUNCTUATION
STOP = "[" + ", ".join(lit(w) for w in rules.QUESTION_STOP_WORDS) + "]"


def docs(t, **cols):
    return t.documents.select("doc_id", *[c.alias(n) for n, c in cols.items()])


@query("x01_question_rules", f"SELECT doc_id, {fold('text', rules.QUESTION_RULES)} AS c FROM documents")
def _(t):
    return docs(t, c=X.replace_all("text", rules.QUESTION_RULES))


LETTER_RUNS = [(f"{c}{{3,}}", c) for c in "abcdefghijklmnopqrstuvwxyz"]


def comment_rules_sql(expr):
    """The rule list with one rule per letter, as the SQL dialect has no back reference."""
    out = []
    for rule in rules.COMMENT_RULES:
        out += LETTER_RUNS if rule == rules.REPEATED_LETTER_RULE else [rule]
    return fold(expr, out)


@query("x02_comment_rules", f"SELECT doc_id, {comment_rules_sql('text')} AS c FROM documents")
def _(t):
    return docs(t, c=X.replace_all("text", rules.COMMENT_RULES))


@query("x03_strip_punctuation", f"SELECT doc_id, regexp_replace(text, {lit(PUNCT)}, '', 'g') AS c FROM documents")
def _(t):
    return docs(t, c=X.strip_punctuation("text"))


@query("x04_stop_words", f"SELECT doc_id, array_to_string(list_filter({words_sql('text')}, lambda w: NOT list_contains({STOP}, w)), ' ') AS c FROM documents")
def _(t):
    return docs(t, c=X.join_words(X.drop_words(X.space_words("text"), rules.QUESTION_STOP_WORDS)))


SPELLING = {"the": "teh", "le": "el", "der": "dre", "los": "las"}


@query("x05_word_replacement", f"SELECT doc_id, array_to_string(list_transform({words_sql('text')}, lambda w: CASE w {' '.join(f'WHEN {lit(a)} THEN {lit(b)}' for a, b in SPELLING.items())} ELSE w END), ' ') AS c FROM documents")
def _(t):
    table = t.spark.createDataFrame(list(SPELLING.items()), "word string, replacement string")
    fixed = V.replace_words(t.documents, "doc_id", X.space_words("text"), table)
    return fixed.select("doc_id", X.join_words(F.col("tokens")).alias("c"))


@query("x06_drop_non_ascii_words", rf"SELECT doc_id, array_to_string(list_filter({words_sql('text')}, lambda w: regexp_full_match(w, '[\x00-\x7F]*')), ' ') AS c FROM documents")
def _(t):
    return docs(t, c=X.join_words(X.drop_non_ascii_words(X.space_words("text"))))


@query("x07_collapse_spam", f"""SELECT doc_id, CASE WHEN len(list_distinct(w)) <= len(w) * 0.3 THEN (SELECT string_agg(x, ' ' ORDER BY i) FROM (SELECT x, min(i) i FROM (SELECT unnest(w) x, generate_subscripts(w, 1) i) GROUP BY x))
  ELSE array_to_string(w, ' ') END AS c FROM (SELECT doc_id, {words_sql('text')} AS w FROM documents)""")
def _(t):
    return docs(t, c=X.join_words(X.collapse_repeats(X.space_words("text"), 0.3)))


def accents_sql(expr):
    return f"translate({expr}, {lit(''.join(rules.ACCENTS.values()))}, {lit(''.join(k * len(v) for k, v in rules.ACCENTS.items()))})"


ODD = rules.ODD_CHARACTER
SYMBOLS = [(r"\|", " "), (r":\)", " smile "), (r"\++", " plus "), ("&+", " "), ("❤", " xin ")]


@query("x08_fold_symbols", f"SELECT doc_id, {fold(accents_sql(fold('text', SYMBOLS)), [(ODD, ' '), (chr(92) + '.{2,}', ' ellipsis ')])} AS c FROM documents")
def _(t):
    return docs(t, c=X.fold_symbols("text"))


@query("x09_log_character_counts", f"""SELECT doc_id, round(ln(1 + len(regexp_extract_all(text, {lit('[' + ''.join(rules.ACCENTS.values()) + ']')}))), 4) AS accents,
  round(ln(1 + len(regexp_extract_all({accents_sql('text')}, {lit(ODD)}))), 4) AS odd FROM documents""")
def _(t):
    return docs(t, **X.log_character_counts("text"))


def marked_sql(expr):
    x = "chr(1)"
    s = f"{x} || regexp_replace({expr}, '([ ,.:?+;/\\t])', {x} || '\\1' || {x}, 'g') || {x}"
    s = f"replace(regexp_replace({s}, {x} || '([0-9]{{2,}})' || {x}, ' numcus ', 'g'), {x}, '')"
    marks = rules.SPLIT_MARKS.replace('\\"', '"')
    return f"list_filter(string_split(regexp_replace({s}, {lit(marks)}, ' \\1 ', 'g'), ' '), lambda w: w <> '' AND w <> '/')"


@query("x10_marked_words", f"SELECT doc_id, array_to_string({marked_sql('text')}, ' ') AS c FROM documents")
def _(t):
    return docs(t, c=F.array_join(X.marked_words("text"), " "))


@query("x10_listing_text", f"""SELECT p_partkey, CASE WHEN p_type = 'PROMO' THEN 'type missing' ELSE 'type ' || array_to_string({marked_sql('p_type || $$/$$ || p_size')}, ' ') END || ' name ' || array_to_string({marked_sql('p_name')}, ' ') ||
  ' . description ' || CASE WHEN p_size % 5 = 0 THEN 'missing .' ELSE array_to_string({marked_sql('p_brand || $$, size $$ || p_size')}, ' ') || ' .' END AS c FROM part""")
def _(t):
    kind = F.when(F.col("p_type") != "PROMO", F.concat("p_type", F.lit("/"), F.col("p_size").cast("string")))
    about = F.when(F.col("p_size") % 5 == 0, "No description yet").otherwise(F.concat("p_brand", F.lit(", size "), F.col("p_size").cast("string")))
    return t.part.select("p_partkey", X.listing_text(kind, "p_name", about).alias("c"))


@query("x11_missing_text", "SELECT p_partkey, CASE WHEN p_size % 5 = 0 OR p_type = 'PROMO' THEN 'missing' ELSE p_type END AS c FROM part")
def _(t):
    c = F.when(F.col("p_size") % 5 == 0, "No description yet").when(F.col("p_type") != "PROMO", F.col("p_type"))
    return t.part.select("p_partkey", X.fill_missing(c, "missing", ["No description yet"]).alias("c"))


@query("x12_normal_words", f"SELECT doc_id, array_to_string(list_filter(string_split(regexp_replace(lower(text), '[^a-z0-9]', ' ', 'g'), ' '), lambda w: length(w) > 1 AND NOT list_contains({STOP}, w)), ' ') AS c FROM documents")
def _(t):
    return docs(t, c=X.join_words(X.normal_words("text", rules.QUESTION_STOP_WORDS)))


LISTING = "ls AS (SELECT p_partkey, p_name AS name, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE split_part(p_name, ' ', 1 + CAST(p_partkey % 2 AS INT)) END AS brand FROM part)"


def listings(t):
    brand = F.split("p_name", " ")[(F.col("p_partkey") % 2).cast("int")]
    return t.part.select("p_partkey", F.col("p_name").alias("name"), F.when(F.col("p_partkey") % 3 != 0, brand).alias("brand"))


def find_brand(df, as_written=False):
    """Fill a missing brand with the first word of the name that is a known brand."""
    known = df.where("brand IS NOT NULL").select(F.col("brand").alias("word")).distinct()
    words = df.where("brand IS NULL").select("p_partkey", F.posexplode(F.split("name", " ")).alias("pos", "word"))
    found = words.join(known, "word").groupBy("p_partkey").agg(F.min_by("word", "pos").alias("found"))
    value = F.when(F.col("found").isNotNull(), F.col("name")) if as_written else F.col("found")
    return df.join(found, "p_partkey", "left").select("p_partkey", F.coalesce("brand", value, F.lit("missing")).alias("brand"))


@query("x13_brand_finder", f"""WITH {LISTING}, b AS (SELECT DISTINCT brand AS word FROM ls WHERE brand IS NOT NULL),
  w AS (SELECT p_partkey, unnest(string_split(name, ' ')) AS word, generate_subscripts(string_split(name, ' '), 1) AS i FROM ls WHERE brand IS NULL),
  f AS (SELECT p_partkey, arg_min(word, i) AS found FROM w JOIN b USING (word) GROUP BY 1) SELECT p_partkey, coalesce(brand, found, 'missing') AS brand FROM ls LEFT JOIN f USING (p_partkey)""")
def _(t):
    return find_brand(listings(t))


@query("x14_word_count", f"SELECT doc_id, CASE WHEN lang = 'fr' THEN 0 ELSE CAST(len({words_sql('lower(text)')}) AS INT) END AS n FROM documents")
def _(t):
    c = F.when(F.col("lang") == "fr", "No description yet").otherwise(F.col("text"))
    return docs(t, n=X.word_count(c, "No description yet"))


HTML = [("(?is)<script[^>]*>.*?</script>", " "), ("(?is)<style[^>]*>.*?</style>", " "), ("(?s)<!--.*?-->", " "), ("(?s)<[^>]+>", " "),
        ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&"), (r"\s+", " ")]


@query("x15_html_text", f"SELECT page_id, trim({fold('html', HTML)}) AS c FROM pages")
def _(t):
    return t.pages.select("page_id", X.html_text("html").alias("c"))


@query("x15_sentences", f"""WITH p AS (SELECT page_id, list_filter(regexp_split_to_array(trim({fold('html', HTML)}), '[.!?]+\\s+'), lambda s: trim(s) <> '') AS l FROM pages)
  SELECT page_id, CAST(generate_subscripts(l, 1) - 1 AS INT) AS pos, unnest(l) AS sentence FROM p""")
def _(t):
    return t.pages.select("page_id", F.posexplode(X.sentences(X.html_text("html"))).alias("pos", "sentence"))


@query("x16_tokens", rf"SELECT doc_id, CAST(len({words_sql('text')}) AS INT) AS spaced, CAST(len(regexp_extract_all(lower(text), '[\pL\pN_][\pL\pN_]+')) AS INT) AS words FROM documents")
def _(t):
    return docs(t, spaced=F.size(X.space_words("text")), words=F.size(X.regex_words("text")))


STEM_SQL = "CASE " + " ".join(
    f"WHEN regexp_matches(w, {lit(p.replace('(?<=', '(?:'))}) THEN regexp_replace(w, {lit(p.split(')')[-1])}, {lit(r)})" for p, r in X.STEM_RULES) + " ELSE w END"


@query("x17_stems", rf"SELECT doc_id, array_to_string(list_transform(regexp_extract_all(lower(text), '[\pL\pN_][\pL\pN_]+'), lambda w: {STEM_SQL}), ' ') AS stems FROM documents")
def _(t):
    return docs(t, stems=F.array_join(F.transform(X.regex_words("text"), X.stem), " "))


def grams_sql(words, n, sep="_"):
    return f"list_transform(range(1, greatest(CAST(len({words}) AS INT) - {n - 2}, 1)), lambda i: array_to_string({words}[i:i + {n - 1}], '{sep}'))"


REGEX_WORDS = r"regexp_extract_all(lower(text), '[\pL\pN_][\pL\pN_]+')"


@query("x18_word_ngrams", f"WITH w AS (SELECT doc_id, {REGEX_WORDS} AS w FROM documents) SELECT doc_id, array_to_string({grams_sql('w', 2)}, ' ') AS two, array_to_string({grams_sql('w', 3, '_*_')}, ' ') AS three FROM w")
def _(t):
    d = docs(t, w=X.regex_words("text"))
    return d.select("doc_id", F.array_join(X.word_ngrams(F.col("w"), 2), " ").alias("two"), F.array_join(X.word_ngrams(F.col("w"), 3, "_*_"), " ").alias("three"))


@query("x19_token_char_ngrams", f"""SELECT g, count(*) AS n FROM (SELECT unnest(list_transform(range(1, length(w) - 1), lambda i: substr(w, i, 3))) AS g FROM (SELECT unnest({REGEX_WORDS}) AS w FROM documents)) GROUP BY 1""")
def _(t):
    return docs(t, w=X.regex_words("text")).select(F.explode(X.token_char_ngrams(F.col("w"), 3)).alias("g")).groupBy("g").agg(F.count(F.lit(1)).alias("n"))


@query("x20_gram_counts", f"""WITH w AS (SELECT doc_id, {REGEX_WORDS} AS w FROM documents), g AS (SELECT doc_id, {grams_sql('w', 2)} AS g FROM w)
  SELECT doc_id, CAST(len(g) AS INT) AS n, CAST(len(list_distinct(g)) AS INT) AS u, round(coalesce(len(list_distinct(g)) / nullif(len(g), 0), 0), 6) AS r FROM g""")
def _(t):
    g = docs(t, w=X.regex_words("text")).select("doc_id", X.word_ngrams(F.col("w"), 2).alias("g"))
    n, u = F.size("g"), F.size(F.array_distinct("g"))
    return rounded(g.select("doc_id", n.alias("n"), u.alias("u"), F.coalesce(F.try_divide(u, n), F.lit(0.0)).alias("r")))


@query("x21_digit_tokens", f"""WITH w AS (SELECT doc_id, {REGEX_WORDS} AS w FROM documents) SELECT doc_id, CAST(len(list_filter(w, lambda x: regexp_full_match(x, '[0-9]+'))) AS INT) AS n,
  round(coalesce(len(list_filter(w, lambda x: regexp_full_match(x, '[0-9]+'))) / nullif(len(w), 0), 0), 6) AS r FROM w""")
def _(t):
    w = docs(t, w=X.regex_words("text"))
    n = X.digit_tokens(F.col("w"))
    return rounded(w.select("doc_id", n.alias("n"), F.coalesce(F.try_divide(n, F.size("w")), F.lit(0.0)).alias("r")))


def count_sql(p):
    return f"CAST(len(regexp_extract_all(text, {lit(p)})) AS INT)"


PATTERNS_SQL = ", ".join(f"{count_sql(p)} AS {n}" for n, p in rules.COUNT_PATTERNS.items())


@query("x22_pattern_counts", f"SELECT doc_id, {PATTERNS_SQL} FROM documents")
def _(t):
    return docs(t, **{n: X.count_matches("text", p) for n, p in rules.COUNT_PATTERNS.items()})


@query("x23_lengths", f"""SELECT doc_id, CAST(length(text) AS INT) AS chars, CAST(len(w) AS INT) AS words, CAST(len(list_distinct(w)) AS INT) AS uniq, round(len(list_distinct(w)) / (len(w) + 1), 6) AS ratio
  FROM (SELECT doc_id, text, {words_sql('text')} AS w FROM documents)""")
def _(t):
    d = docs(t, text=F.col("text"), w=X.space_words("text"))
    u = F.size(F.array_distinct("w"))
    return rounded(d.select("doc_id", F.length("text").alias("chars"), F.size("w").alias("words"), u.alias("uniq"), (u / (F.size("w") + 1)).alias("ratio")))


def char_gram_sql(expr):
    low = fold(f"lower({expr})", [("[\\n\\t\\x08\\r]", " ")] + rules.CHAR_GRAM_RULES)
    words = f"array_to_string(list_transform({words_sql(low)}, lambda w: regexp_replace(w, {lit(PUNCT)}, '', 'g')), ' ')"
    return fold(words, [(r"\d+", " "), (r"\s+", " "), (" ", "# #"), (r"\s+$", "")])


@query("x24_char_gram_text", f"SELECT doc_id, {char_gram_sql('text')} AS c FROM documents")
def _(t):
    return docs(t, c=X.char_gram_text("text"))


@query("x25_contains_word", "SELECT a.conv_id, a.turn, CAST(contains(lower(a.text), 'the') AS INT) AS q1, CAST(contains(lower(b.text), 'the') AS INT) AS q2, CAST(contains(lower(a.text), 'the') AND contains(lower(b.text), 'the') AS INT) AS both FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1")
def _(t):
    from tessera.catalog.pair_queries import pairs
    p = pairs(t).select("conv_id", "turn", X.contains_word("a", "the").alias("q1"), X.contains_word("b", "the").alias("q2"))
    return p.withColumn("both", F.col("q1") * F.col("q2"))


VOC = """w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\pL\\pN]+')) AS word, generate_subscripts(regexp_extract_all(lower(text), '[\\pL\\pN]+'), 1) AS pos FROM documents),
  v AS (SELECT word, row_number() OVER (ORDER BY count(*) DESC, word) AS id FROM w GROUP BY 1),
  s AS (SELECT doc_id, coalesce(ids, []) AS ids FROM documents LEFT JOIN (SELECT doc_id, list(id ORDER BY pos) AS ids FROM w JOIN v USING (word) GROUP BY 1) USING (doc_id))"""


@query("x26_id_sequences", f"WITH {VOC} SELECT doc_id, ids FROM s")
def _(t):
    return V.id_sequences(t.documents.select("doc_id", "text").repartition("doc_id"), "doc_id", X.letter_words("text"))


@query("x27_padded_sequences", f"WITH {VOC} SELECT doc_id, list_concat(list_resize([]::BIGINT[], greatest(80 - len(ids), 0), 0), ids[greatest(len(ids) - 79, 1):]) AS ids FROM s")
def _(t):
    s = V.id_sequences(t.documents.select("doc_id", "text").repartition("doc_id"), "doc_id", X.letter_words("text"))
    return s.select("doc_id", X.pad_sequence(F.col("ids"), 80).alias("ids"))


def letters_sql(x, n):
    return f"list_transform(range(1, greatest(length({x}) - {n - 2}, 1)), lambda i: substr({x}, i, {n}))"


def part_sql(n):
    c, r = letters_sql("c", n), letters_sql("r", n)
    return f"0.33::DOUBLE * list_sum(list_transform(list_distinct({c}), lambda g: least(len(list_filter({c}, lambda x: x = g)), len(list_filter({r}, lambda x: x = g))))) / (length(c) - {n - 1} + 0.0001::DOUBLE)"


@query("x28_spelling_neighbours", f"""WITH w AS (SELECT unnest(regexp_extract_all(lower(text), '\\pL+')) AS word FROM documents), b AS (SELECT word, count(*) n FROM w GROUP BY 1 HAVING count(*) > 10 AND length(word) >= 5),
  p AS (SELECT x.word AS c, y.word AS r, y.n AS rn FROM b x JOIN b y ON substr(x.word, 1, 3) = substr(y.word, 1, 3) AND abs(length(x.word) - length(y.word)) <= 3 AND (y.n > x.n OR (y.n = x.n AND y.word < x.word))
    AND len(list_intersect({letters_sql('y.word', 1)}, {letters_sql('x.word', 1)})) >= len(list_distinct({letters_sql('y.word', 1)})) * 0.7),
  s AS (SELECT c, r, rn, {part_sql(1)} AS p1, {part_sql(2)} AS p2, {part_sql(3)} AS p3 FROM p),
  z AS (SELECT c, r, rn, round((CASE WHEN length(c) > length(r) THEN 0.0 ELSE greatest(least(1 - length(r) / length(c), 0.0), -0.5) END)::DOUBLE + p1 + p2 + p3, 6) AS score FROM s WHERE p1 >= 0.25 AND p2 >= 0.25 AND p3 >= 0.25)
  SELECT c AS word, r AS near, score FROM (SELECT *, row_number() OVER (PARTITION BY c ORDER BY score DESC, rn DESC, r DESC) k FROM z WHERE score > 0.60) WHERE k = 1""")
def _(t):
    words = t.documents.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\pL+"), F.lit(0))).alias("word"))
    return V.spelling_neighbours(words.groupBy("word").agg(F.count(F.lit(1)).alias("n")))


@query("x29_supported_categories", """WITH c AS (SELECT p_name || '/' || p_type AS cat, count(*) AS n FROM part GROUP BY 1)
  SELECT cat, CASE WHEN n >= 7 THEN 1 + dense_rank() OVER (PARTITION BY n >= 7 ORDER BY cat) ELSE 1 END AS id, CASE WHEN n >= 7 THEN n ELSE (SELECT CAST(sum(n) AS BIGINT) FROM c WHERE n < 7) END AS n FROM c""")
def _(t):
    cats = t.part.select(F.concat_ws("/", "p_name", "p_type").alias("cat"))
    return V.supported_ids(cats, "cat", 7, first=2, other=1)


@query("x30_balanced_word_counts", """WITH d AS (SELECT doc_id, text, doc_id % 4 = 0 AS test FROM documents), r AS (SELECT count(*) FILTER (NOT test) * 0.5 / count(*) FILTER (test) AS r FROM d),
  w AS (SELECT test, unnest(regexp_extract_all(lower(text), '[\\pL\\pN]+')) AS word FROM d) SELECT word, CAST(count(*) FILTER (NOT test) AS DOUBLE) AS train_n, round(count(*) FILTER (test) * (SELECT r FROM r), 6) AS test_n FROM w GROUP BY 1""")
def _(t):
    d = t.documents
    return rounded(V.balanced_word_counts(d.where("doc_id % 4 <> 0"), d.where("doc_id % 4 = 0"), X.letter_words("text")))


CG = char_gram_sql("text")


@query("f23_comment_features", f"""WITH b AS (SELECT *, {words_sql('text')} AS w, {CG} AS c FROM documents), d AS (SELECT *, {words_sql('c')} AS cw, len(list_distinct(list_filter(string_split(c, ''), lambda x: x <> ''))) AS letters FROM b)
  SELECT doc_id, {PATTERNS_SQL}, {count_sql('(?i)spam')} AS nb_spam, CAST(len(w) AS INT) AS raw_word_len, CAST(length(text) AS INT) AS raw_char_len, CAST(len(list_distinct(w)) AS INT) AS unique_word_len,
  round(len(list_distinct(w)) / (len(w) + 1), 6) AS word_ratio, CAST(len(cw) AS INT) AS clean_word_len, CAST(length(c) AS INT) AS clean_char_len, CAST(letters AS INT) AS clean_chars,
  round(letters / (1 + least(99, length(c))), 6) AS clean_chars_ratio, CAST(len(list_distinct(cw)) AS INT) AS clean_unique_word_len, round(len(list_distinct(cw)) / (len(cw) + 1), 6) AS clean_word_ratio FROM d""")
def _(t):
    d = docs(t, text=F.col("text"), clean=X.char_gram_text("text"))
    counts = X.comment_counts(F.col("text"), F.col("clean"), {"nb_spam": "(?i)spam"})
    return rounded(d.select("doc_id", *[c.alias(n) for n, c in counts.items()]))


@query("f24_clean_comment", f"""WITH r AS (SELECT doc_id, list_filter(list_transform({words_sql(comment_rules_sql('text'))}, lambda w: CASE w WHEN 'teh' THEN 'the' WHEN 'wich' THEN 'which' ELSE w END), lambda w: regexp_full_match(w, '[\\x00-\\x7F]*')) AS w FROM documents)
  SELECT doc_id, lower(regexp_replace(CASE WHEN len(w) > 0 AND len(list_distinct(w)) <= len(w) * 0.06 THEN (SELECT string_agg(x, ' ' ORDER BY i) FROM (SELECT x, min(i) i FROM (SELECT unnest(w) x, generate_subscripts(w, 1) i) GROUP BY x))
    ELSE array_to_string(w, ' ') END, {lit(PUNCT)}, '', 'g')) AS c FROM r""")
def _(t):
    return docs(t, c=X.clean_comment("text", {"teh": "the", "wich": "which"}))


@query("f27_nb_token_rows", f"""WITH g AS (SELECT doc_id, toxic, unnest(list_concat(w, {grams_sql('w', 2, '_*_')})) AS word FROM (SELECT doc_id, toxic, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents JOIN labels USING (doc_id))),
  c AS (SELECT word, count(*) FILTER (toxic = 1) + 1 AS p, count(*) FILTER (toxic = 0) + 1 AS q FROM g GROUP BY 1),
  r AS (SELECT word, dense_rank() OVER (ORDER BY word) AS idx, ln(p / (SELECT sum(p) FROM c)) - ln(q / (SELECT sum(q) FROM c)) AS ratio FROM c)
  SELECT doc_id, toxic || ' ' || string_agg(printf('%d:%.6f', idx, ratio), ' ' ORDER BY idx) AS line FROM (SELECT DISTINCT doc_id, toxic, word FROM g) JOIN r USING (word) GROUP BY doc_id, toxic""")
def _(t):
    w = F.col("w")
    tokens = t.documents.join(t.labels, "doc_id").select("doc_id", "toxic", "text").repartition("doc_id").select("doc_id", "toxic", X.ascii_words("text").alias("w"))
    rows = tokens.select("doc_id", "toxic", F.explode(F.concat(w, X.word_ngrams(w, 2, "_*_"))).alias("word"))
    ratios = log_count_ratio(rows, "word", "toxic")
    # written: the shuffles that number the words are gone before the cells are moved
    ratios = cut_lineage(ratios.join(dense_codes(ratios, "word", "idx"), "word"))
    return svmlight_lines(rows.distinct().join(ratios, "word"), "doc_id", "toxic", "idx", "ratio")
