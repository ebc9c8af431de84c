"""Feature tables of text pairs (key, a, b)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import pairs as S
from tessera.functions import text as X
from tessera.functions.scalars import safe_ratio
from tessera.operators.aggregates import array_moments, array_shape
from tessera.operators.fills import cap_by_class
from tessera.operators.joins import common_neighbours
from tessera.operators.similarity import (
    gram_distances, gram_overlap, inverse_weights, pair_degrees, pair_grams, sentence_vectors, weighted_share,
)
from tessera.session import cut_lineage

# characters of the texts of pairs that one task takes
CHARACTERS = 1 << 23


def joined(parts: Sequence[DataFrame], key: str) -> DataFrame:
    return reduce(lambda x, y: x.join(y, key, "left"), parts)


def overlap_table(pairs: DataFrame, key: str, stop: Sequence[str], ends: tuple[str, str] | None = None) -> DataFrame:
    """Word overlap of the lowered tokens, plain and weighted by inverse frequency.

    ``ends`` names the columns that identify the two texts; with them the
    frequencies of both ends and their common partners are added.
    """
    words = pairs.select(key, X.space_words(F.lower("a")).alias("x"), X.space_words(F.lower("b")).alias("y"))
    x, y = F.col("x"), F.col("y")
    base = words.select(
        key, S.shared_share(x, y, stop).alias("word_match"),
        *[c.alias(n) for n, c in S.overlap_features(x, y, stop).items()],
    )
    grams = pair_grams(words, key, x, y)
    weights = inverse_weights(grams)
    return joined([
        base, weighted_share(grams, key, weights).withColumnRenamed("share", "tfidf_wm"),
        weighted_share(grams, key, weights, stop).withColumnRenamed("share", "tfidf_wm_stops"),
        *([degree_table(pairs, key, *ends)] if ends else []),
    ], key)


def gram_table(pairs: DataFrame, key: str) -> DataFrame:
    """Counts, shares, positions, Jaccard and Dice of word 1-, 2- and 3-grams.

    Single words are lowered runs of word characters; longer grams are made of
    the raw words between spaces.
    """
    base = pairs.select(
        key, X.regex_words("a").alias("a1"), X.regex_words("b").alias("b1"),
        X.space_words("a").alias("aw"), X.space_words("b").alias("bw"),
    ).select(
        key, "a1", "b1", *[X.word_ngrams(F.col(f"{s}w"), n).alias(f"{s}{n}") for s in "ab" for n in (2, 3)]
    )
    sides = [(s, n) for n in (1, 2, 3) for s in "ab"]
    places = common_places(base, key, sides)
    wide = base.join(places, key, "left")
    for s, n in sides:
        found = F.coalesce(F.size(f"__{s}{n}"), F.lit(0))
        wide = wide.withColumn(f"{s}{n}_in_{'b' if s == 'a' else 'a'}", found).withColumn(
            f"p{s}{n}", F.coalesce(f"__{s}{n}", F.array(F.lit(0)))
        )
    out = [F.col(key)]
    for n in (1, 2, 3):
        a, b = F.col(f"a{n}"), F.col(f"b{n}")
        for s, g, o in (("a", a, "b"), ("b", b, "a")):
            count, unique = F.size(g), F.size(F.array_distinct(g))
            out += [count.alias(f"count_{s}{n}"), unique.alias(f"unique_{s}{n}"),
                    safe_ratio(unique, count).alias(f"unique_ratio_{s}{n}"),
                    F.col(f"{s}{n}_in_{o}"), safe_ratio(F.col(f"{s}{n}_in_{o}"), count).alias(f"ratio_{s}{n}_in_{o}")]
            for name, c in array_moments(F.col(f"p{s}{n}")).items():
                out += [c.alias(f"pos_{s}{n}_{name}"), safe_ratio(c, count).alias(f"norm_pos_{s}{n}_{name}")]
        out += [safe_ratio(F.col(f"b{n}_in_a"), F.size(a)).alias(f"b{n}_in_a_per_a"),
                safe_ratio(F.col(f"b{n}_in_a"), F.col(f"a{n}_in_b")).alias(f"b{n}_in_a_per_a_in_b"),
                S.jaccard(a, b).alias(f"jaccard_{n}"), S.dice(a, b).alias(f"dice_{n}")]
    for s in "ab":
        digits = X.digit_tokens(F.col(f"{s}1"))
        out += [digits.alias(f"digits_{s}"), safe_ratio(digits, F.size(f"{s}1")).alias(f"digit_ratio_{s}")]
    return wide.select(*out)


def common_places(base: DataFrame, key: str, sides: Sequence[tuple[str, int]]) -> DataFrame:
    """Per pair the 1-based places of the grams that the other side has too: (key, __a1, __b1, ...).

    Grams meet in a join on (pair, length, gram), so a long text costs its length.
    """
    lists = F.array(*[F.struct(F.lit(s).alias("s"), F.lit(n).alias("n"), F.col(f"{s}{n}").alias("g")) for s, n in sides])
    each = base.select(key, F.explode(lists).alias("x")).select(
        key, "x.s", "x.n", F.posexplode("x.g").alias("place", "gram")
    )
    shared = each.groupBy(key, "n", "gram").agg(F.min("s").alias("one"), F.max("s").alias("two")).where("one < two")
    hits = each.join(shared.drop("one", "two"), [key, "n", "gram"])
    return hits.groupBy(key).agg(*[
        F.nullif(
            F.sort_array(F.collect_list(F.when((F.col("s") == s) & (F.col("n") == n), F.col("place") + 1))),
            F.array().cast("array<int>"),
        ).alias(f"__{s}{n}") for s, n in sides
    ])


def degree_table(pairs: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """How often each side of a pair occurs in any pair, and how many partners both sides share."""
    edges = pairs.select(key, F.col(a).alias("__a"), F.col(b).alias("__b"))
    degrees = pair_degrees(edges, "__a", "__b")
    shared = common_neighbours(edges.select("__a", "__b").distinct(), "__a", "__b")
    return degrees.join(shared, ["__a", "__b"], "left").select(
        key, F.col("__a_freq").alias("a_freq"), F.col("__b_freq").alias("b_freq"), F.coalesce("common", F.lit(0)).alias("common"),
    )


def dealt_by_text(pairs: DataFrame, key: str) -> DataFrame:
    """The pairs dealt by key, about ``CHARACTERS`` of text to a task."""
    chars = pairs.agg(F.sum(F.coalesce(F.length("a"), F.lit(0)) + F.coalesce(F.length("b"), F.lit(0)))).first()[0] or 0
    least = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return pairs.repartition(max(least, -(-chars // CHARACTERS)), key)


def char_table(pairs: DataFrame, key: str, label: str | None = None) -> DataFrame:
    """Lengths, and overlap and TF-IDF distances of character 1-, 2- and 3-grams.

    With a 0/1 ``label`` the length ratio is also given capped by class 1.
    """
    pairs = cut_lineage(pairs.select(key, "a", "b", *([label] if label else [])))
    # a pair's grams are counted where its texts lie
    dealt = dealt_by_text(pairs.select(key, "a", "b"), key)
    lengths = pairs.select(key, *([label] if label else []), *[c.alias(n) for n, c in S.length_features(F.col("a"), F.col("b")).items()])
    if label:
        lengths = lengths.withColumn("ratio_len_capped", cap_by_class(lengths, "ratio_len", label)).drop(label)
    parts = [lengths]
    documents = pairs.agg(2 * F.count(F.lit(1))).scalar()
    for n in (1, 2, 3):
        # written once: both tables read them, each with a small shuffle by pair
        grams = cut_lineage(pair_grams(dealt, key, X.char_ngrams("a", n), X.char_ngrams("b", n)))
        for table in (gram_overlap(grams, key), gram_distances(grams, key, documents)):
            parts.append(table.select(key, *[F.col(c).alias(f"g{n}_{c}") for c in table.columns if c != key]))
    return joined(parts, key)


def vector_table(pairs: DataFrame, key: str, vectors: DataFrame, ratio_words=X.letter_words) -> DataFrame:
    """Distances between sentence vectors, their skewness and kurtosis, and text ratios of ``ratio_words``."""
    x, y = F.col("x"), F.col("y")
    # ratios are made where a pair's texts lie, before the join
    base = dealt_by_text(pairs.select(key, "a", "b"), key).select(key, ratio_words("a").alias("x"), ratio_words("b").alias("y")).select(
        key, *[c.alias(n) for n, c in S.text_ratios(x, y).items()]
    )
    sides = sentence_vectors(pairs, key, vectors, {"va": X.letter_words("a"), "vb": X.letter_words("b")})
    both = joined([base, sides], key)
    va, vb = F.col("va"), F.col("vb")
    return both.select(
        *base.columns, *[c.alias(n) for n, c in S.vector_distances(va, vb).items()],
        *[c.alias(f"{n}_a") for n, c in array_shape(va).items()], *[c.alias(f"{n}_b") for n, c in array_shape(vb).items()],
    )
