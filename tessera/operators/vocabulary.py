"""Word tables: id sequences, weighted counts, spelling neighbours, rare categories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import char_ngrams
from tessera.operators.ranges import dense_codes, split_window
from tessera.session import cut_lineage


def frequency_ids(words: DataFrame, word: str = "word") -> DataFrame:
    """(word, n, id): ids from 1 by falling count, then by word."""
    # written once: the cut points read the counts twice before they are numbered
    counts = cut_lineage(words.groupBy(word).agg(F.count(F.lit(1)).alias("n")).withColumn("__neg", -F.col("n")))
    return split_window(counts, [], ["__neg", word], row_number="id").drop("__neg")


def id_sequences(df: DataFrame, key: str, tokens: Column) -> DataFrame:
    """Texts as lists of word ids in reading order; (text, word) rows are joined, not single tokens."""
    long = df.select(key, F.posexplode(tokens).alias("pos", "word"))
    ids = frequency_ids(long)
    places = long.groupBy(key, "word").agg(F.collect_list("pos").alias("places"))
    coded = places.join(ids.select("word", "id"), "word").select(key, "id", F.explode("places").alias("pos"))
    ordered = F.sort_array(F.collect_list(F.struct("pos", "id")))
    lists = coded.groupBy(key).agg(F.transform(ordered, lambda x: x["id"]).alias("ids"))
    return df.select(key).join(lists, key, "left").select(
        key, F.coalesce("ids", F.array().cast("array<bigint>")).alias("ids")
    )


def replace_words(df: DataFrame, key: str, tokens: Column, table: DataFrame, out: str = "tokens") -> DataFrame:
    """(key, out): tokens with listed words replaced, by a join with ``table`` (word, replacement) of any size.

    ``key`` is unique; an empty list stays empty.
    """
    lists = df.select(key, tokens.alias("__t"))
    each = lists.select(key, F.posexplode("__t").alias("__p", "word"))
    new = each.join(table.select("word", "replacement"), "word", "left").groupBy(key).agg(
        F.sort_array(F.collect_list(F.struct("__p", F.coalesce("replacement", "word").alias("w")))).alias("__new")
    )
    return lists.join(new, key, "left").select(
        key, F.coalesce(F.transform("__new", lambda x: x["w"]), F.array().cast("array<string>")).alias(out)
    )


def balanced_word_counts(train: DataFrame, test: DataFrame, tokens: Column) -> DataFrame:
    """Word counts of train and test, the test counts scaled by half the ratio of row numbers."""
    ratio = train.agg(F.count(F.lit(1))).scalar() * 0.5 / test.agg(F.count(F.lit(1))).scalar()
    one = train.select(F.explode(tokens).alias("word")).groupBy("word").agg(F.count(F.lit(1)).cast("double").alias("train_n"))
    two = test.select(F.explode(tokens).alias("word")).groupBy("word").agg((F.count(F.lit(1)) * ratio).alias("test_n"))
    return one.join(two, "word", "full").fillna(0.0, ["train_n", "test_n"])


def supported_ids(df: DataFrame, column: str, min_count: int, first: int, other: int) -> DataFrame:
    """(value, id, n): values with enough rows get ids from ``first``, the rest share ``other``."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    kept = counts.where(F.col("n") >= min_count)
    codes = dense_codes(kept, column, "id", start=first)
    rest = counts.where(F.col("n") < min_count)
    rest_total = rest.agg(F.coalesce(F.sum("n"), F.lit(0))).scalar()
    return kept.join(codes, column).select(column, "id", "n").unionByName(
        rest.select(column, F.lit(other).cast("long").alias("id"), rest_total.alias("n"))
    )


def letter_score(c: Column, r: Column) -> Column:
    """Clipped letter n-gram precision of c against r for n = 1, 2, 3; 0 when one n falls short."""
    letters = lambda x: F.array_distinct(char_ngrams(x, 1))
    shared = F.size(F.array_intersect(letters(r), letters(c))) >= F.size(letters(r)) * 0.7
    # the longer word is not penalised, the shorter by at most a half
    brevity = F.when(F.length(c) > F.length(r), 0.0).otherwise(
        F.greatest(F.least(1 - F.length(r) / F.length(c), F.lit(0.0)), F.lit(-0.5))
    )
    parts = []
    for n in (1, 2, 3):
        cg, rg = char_ngrams(c, n), char_ngrams(r, n)
        matched = F.aggregate(
            F.array_distinct(cg), F.lit(0),
            lambda acc, g: acc + F.least(F.size(F.filter(cg, lambda x: x == g)), F.size(F.filter(rg, lambda x: x == g))),
        )
        parts.append(0.33 * matched / (F.size(cg) + 0.0001))
    enough = shared & (parts[0] >= 0.25) & (parts[1] >= 0.25) & (parts[2] >= 0.25)
    return F.when(enough, brevity + parts[0] + parts[1] + parts[2]).otherwise(0.0)


def _share_rare(ranked: DataFrame) -> DataFrame:
    """(word, n, near, near_n): words that share a gram among the rarest of both, for each shared one.

    ``ranked`` is (word, n, block, g) with the word's grams from the rarest. Of a word with t trigrams at least
    m = ceil(0.7575 t) must match. The rarest shared gram is then among the word's first t - m + 1, and
    among the first u - m + 1 of a near word with u trigrams, whose grams are listed for each length of a word it
    may be near to. Repeated trigrams only shrink the distinct sets, hence full lengths are used. Pairs that
    share fewer than m grams, even if the word's repeated ones all counted, are left out.
    """
    def first(size: Column, matched_of: Column) -> Column:
        count = size - F.ceil(0.7575 * matched_of) + 1
        return F.explode(F.transform(F.slice("g", F.lit(1), F.greatest(count, F.lit(0)).cast("int")), lambda x: x["gram"]))

    own = F.transform("g", lambda x: x["gram"])
    total = F.length("word") - 2
    rare = ranked.select("word", "n", "block", F.length("word").alias("long"), own.alias("own"), first(total, total).alias("gram"))
    lengths = ranked.withColumn("long", F.explode(F.array(*[F.length("word") + d for d in range(-3, 4)])))
    other = lengths.select(
        F.col("word").alias("near"), F.col("n").alias("near_n"), "block", "long", own.alias("near_own"), first(total, F.col("long") - 2).alias("gram")
    )
    more = (F.col("near_n") > F.col("n")) | ((F.col("near_n") == F.col("n")) & (F.col("near") < F.col("word")))
    enough = F.size(F.array_intersect("own", "near_own")) + total - F.size("own") >= F.ceil(0.7575 * total)
    return rare.join(other, ["gram", "long", "block"]).where(more & enough).select("word", "n", "near", "near_n")


def spelling_neighbours(words: DataFrame, min_count: int = 10, min_length: int = 5, threshold: float = 0.60) -> DataFrame:
    """For each word the best-scoring more frequent word with the same first three letters.

    A score above 0 needs three quarters of a word's letter trigrams in the
    other word, so two words can only match when they share one of the rarest
    trigrams of both. Only such pairs are scored; none is lost.
    """
    base = words.where((F.col("n") > min_count) & (F.length("word") >= min_length)).select("word", "n")
    grams = base.select("word", "n", F.substring("word", 1, 3).alias("block"), F.explode(F.array_distinct(char_ngrams("word", 3))).alias("gram"))
    seen = grams.groupBy("block", "gram").agg(F.count(F.lit(1)).alias("df"))
    # written once: both sides of the pairs read it
    ranked = cut_lineage(grams.join(seen, ["gram", "block"]).groupBy("word", "n", "block").agg(
        F.sort_array(F.collect_list(F.struct("df", "gram"))).alias("g")
    ))
    pairs = _share_rare(ranked).select("word", "near", "near_n").distinct()
    scored = pairs.withColumn("score", F.round(letter_score(F.col("word"), F.col("near")), 6))
    best = F.max_by(F.struct("near", "score"), F.struct(F.col("score"), F.col("near_n"), F.col("near")))
    # the best score is held to the threshold, not each: a filter would move before distinct, and score a pair again for each gram
    return scored.groupBy("word").agg(best.alias("b")).select("word", "b.near", "b.score").where(F.col("score") > threshold)
