"""Similarity between linked sets and between grams of text pairs."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.session import cut_lineage

# words, and texts at most, whose vectors are summed together: more words share more vectors
GROUP_WORDS, GROUP_TEXTS = 1 << 21, 1 << 16


def linked_set_distance(sets: DataFrame, links: DataFrame) -> DataFrame:
    """Jaccard and Dice of the item sets at both ends of each link, own row excluded.

    ``sets`` is (id, item) without repeats, ``links`` is (id, id2, ...). Links
    whose ends lack a set are dropped, as no distance is defined for them.
    """
    sizes = sets.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    own = links.where("id <> id2")
    left = own.select("id", "id2").join(sets, "id")
    common = left.join(sets.withColumnRenamed("id", "id2"), ["id2", "item"]).groupBy("id", "id2").agg(
        F.count(F.lit(1)).alias("c")
    )
    sized = own.join(sizes, "id").join(sizes.select(F.col("id").alias("id2"), F.col("n").alias("n2")), "id2")
    c = F.coalesce(F.col("c"), F.lit(0))
    return sized.join(common, ["id", "id2"], "left").select(
        *own.columns, (c / (F.col("n") + F.col("n2") - c)).alias("jaccard"), (2 * c / (F.col("n") + F.col("n2"))).alias("dice")
    )


def pair_grams(pairs: DataFrame, key: str, a: Column, b: Column) -> DataFrame:
    """Gram counts of both sides of each pair: (key, gram, ca, cb)."""
    tagged = F.concat(
        F.transform(a, lambda g: F.struct(g.alias("gram"), F.lit(1).alias("l"))),
        F.transform(b, lambda g: F.struct(g.alias("gram"), F.lit(0).alias("l"))),
    )
    return pairs.select(key, F.explode(tagged).alias("t")).groupBy(key, F.col("t.gram").alias("gram")).agg(
        F.sum("t.l").alias("ca"), F.sum(1 - F.col("t.l")).alias("cb")
    )


def gram_overlap(grams: DataFrame, key: str) -> DataFrame:
    """Jaccard of gram sets, and of gram multisets over the sum and over the larger side."""
    ca, cb = F.col("ca"), F.col("cb")
    low = F.sum(F.least(ca, cb))
    return grams.groupBy(key).agg(
        (F.count_if((ca > 0) & (cb > 0)) / F.count(F.lit(1))).alias("jaccard"),
        (low / F.sum(ca + cb)).alias("all_jaccard"),
        (low / F.sum(F.greatest(ca, cb))).alias("all_jaccard_max"),
    )


def gram_distances(grams: DataFrame, key: str, documents: Column) -> DataFrame:
    """TF-IDF cosine distance and Euclidean distances under l2, l1 and plain-count weights.

    idf = ln((1 + documents) / (1 + documents with the gram)) + 1.
    """
    seen = grams.groupBy("gram").agg(
        (F.count_if(F.col("ca") > 0) + F.count_if(F.col("cb") > 0)).alias("df")
    ).select("gram", (F.log((1 + documents) / (1 + F.col("df"))) + 1).alias("idf"))
    # written, so that Spark knows the size of a small table and does not shuffle the grams
    w = grams.join(cut_lineage(seen), "gram").select(
        key, "ca", "cb", (F.col("ca") * F.col("idf")).alias("x"), (F.col("cb") * F.col("idf")).alias("y")
    )
    dot = lambda p, q: F.sum(F.col(p) * F.col(q))
    s = w.groupBy(key).agg(
        dot("x", "x").alias("xx"), dot("y", "y").alias("yy"), dot("x", "y").alias("xy"),
        F.sum("x").alias("sx"), F.sum("y").alias("sy"),
        dot("ca", "ca").alias("aa"), dot("cb", "cb").alias("bb"), dot("ca", "cb").alias("ab"),
    )

    def gap(pp, qq, pq, p, q):
        """Distance of two vectors scaled by 1/p and 1/q, from their dot products."""
        part = lambda v, d: F.coalesce(F.try_divide(v, d), F.lit(0.0))
        square = part(F.col(pp), p * p) + part(F.col(qq), q * q) - 2 * part(F.col(pq), p * q)
        return F.sqrt(F.greatest(square, F.lit(0.0)))

    norm = lambda c: F.sqrt(F.col(c))
    return s.select(
        key,
        (1 - F.coalesce(F.try_divide(F.col("xy"), norm("xx") * norm("yy")), F.lit(1.0))).alias("tfidf_cosine"),
        gap("xx", "yy", "xy", norm("xx"), norm("yy")).alias("tfidf_l2_euclidean"),
        gap("xx", "yy", "xy", F.col("sx"), F.col("sy")).alias("tfidf_l1_euclidean"),
        gap("aa", "bb", "ab", norm("aa"), norm("bb")).alias("tf_l2_euclidean"),
    )


def weighted_share(grams: DataFrame, key: str, weights: DataFrame, stop=()) -> DataFrame:
    """Weight of words on both sides over the weight of all, counted once per side."""
    kept = grams.where(~F.col("gram").isin(list(stop))) if stop else grams
    w = kept.join(weights, "gram", "left").select(
        key, F.coalesce("weight", F.lit(0.0)).alias("w"),
        (F.col("ca") > 0).cast("int").alias("a"), (F.col("cb") > 0).cast("int").alias("b"),
    )
    share = F.try_divide(2 * F.sum(F.col("w") * F.col("a") * F.col("b")), F.sum(F.col("w") * (F.col("a") + F.col("b"))))
    empty = (F.max("a") == 0) | (F.max("b") == 0)
    return w.groupBy(key).agg(F.when(empty, 0.0).otherwise(share).alias("share"))


def inverse_weights(grams: DataFrame, eps: float = 10000, min_count: int = 2) -> DataFrame:
    """1 / (occurrences + eps) per word over both sides; rarer words than ``min_count`` weigh 0."""
    n = F.sum(F.col("ca") + F.col("cb"))
    return grams.groupBy("gram").agg(F.when(n < min_count, 0.0).otherwise(1 / (n + eps)).alias("weight"))


def pair_degrees(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """How often each end of a pair occurs on either side of any pair."""
    both = pairs.select(F.col(a).alias("__n")).unionByName(pairs.select(F.col(b).alias("__n")))
    freq = both.groupBy("__n").agg(F.count(F.lit(1)).alias("__f"))
    one = freq.select(F.col("__n").alias(a), F.col("__f").alias(f"{a}_freq"))
    two = freq.select(F.col("__n").alias(b), F.col("__f").alias(f"{b}_freq"))
    return pairs.join(one, a).join(two, b)


def _vector_sums(sides: list[str]):
    """For one group of keys: the texts' words and the vectors of all words they hold -> unit sums per key and side."""

    def run(texts: pa.Table, found: pa.Table) -> pa.Table:
        found = found.filter(pc.is_valid(found.column("vector")))
        vectors = found.column("vector").combine_chunks()
        each = vectors.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(vectors), -1) if len(vectors) else np.zeros((0, 0))
        named = found.column("word").combine_chunks().unique()
        of_word = np.zeros((len(named), each.shape[1]))
        np.add.at(of_word, pc.index_in(found.column("word"), named).to_numpy(), each)
        keys = texts.column("key").combine_chunks().dictionary_encode(null_encoding="encode")
        out = [keys.dictionary]
        for side in sides:
            lists = texts.column(side).combine_chunks()
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
            at = pc.fill_null(pc.index_in(lists.flatten(), named), -1).to_numpy()
            row = np.repeat(keys.indices.to_numpy(), sizes)[at >= 0]
            order = np.argsort(row, kind="stable")
            row, at = row[order], at[at >= 0][order]
            sums = np.zeros((len(keys.dictionary), each.shape[1]))
            for start in range(0, len(row), 1 << 14):
                part = row[start : start + (1 << 14)]
                first = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
                sums[part[first]] += np.add.reduceat(of_word[at[start : start + (1 << 14)]], first)
            length = np.sqrt((sums * sums).sum(axis=1))
            unit = sums / np.where(length == 0, 1, length)[:, None]
            some = np.isin(np.arange(len(sums)), row)
            ends = np.append(0, np.cumsum(np.where(some, each.shape[1], 0))).astype(np.int32)
            values = pa.array(unit[some].ravel(), pa.float64())
            out.append(pa.ListArray.from_arrays(pa.array(ends), values, mask=pa.array(~some)))
        return pa.Table.from_arrays(out, ["key", *sides])

    return run


def sentence_vectors(texts: DataFrame, key: str, vectors: DataFrame, sides: dict[str, Column]) -> DataFrame:
    """Sum of the vectors of a text's words, scaled to length 1: (key, one column per side).

    ``sides`` names the word lists of a row; a key with several rows sums over all. A side without any
    known word is null. Keys are dealt into groups of about ``GROUP_WORDS`` words and each group asks for the
    vector of each of its words once, so vectors do not travel with every word of every text.
    """
    kind = texts.schema[key].dataType.simpleString()
    words = cut_lineage(texts.select(F.col(key).alias("key"), *[c.alias(n) for n, c in sides.items()]))
    count, rows = words.agg(F.sum(sum((F.coalesce(F.size(n), F.lit(0)) for n in sides), F.lit(0))), F.count(F.lit(1))).first()
    groups = max(1, -(-(count or 0) // GROUP_WORDS), -(-rows // GROUP_TEXTS))
    dealt = words.withColumn("chunk", F.pmod(F.xxhash64("key"), F.lit(groups)))
    lists = F.flatten(F.array(*[F.coalesce(n, F.array().cast("array<string>")) for n in sides]))
    asked = dealt.select("chunk", F.explode(lists).alias("word")).distinct()
    found = asked.join(vectors.select("word", "vector"), "word").select(F.col("chunk").alias("of"), "word", "vector")
    schema = ", ".join([f"key {kind}", *[f"{n} array<double>" for n in sides]])
    sums = dealt.groupBy("chunk").cogroup(found.groupBy("of")).applyInArrow(_vector_sums(list(sides)), schema)
    return sums.withColumnRenamed("key", key)


def word_grid(pairs: DataFrame, key: str, vectors: DataFrame, idf: DataFrame, size: int = 10) -> DataFrame:
    """Similarity of the first ``size`` words of one side with those of the other, weighted by idf.

    Cells missing a word or a vector are 0; rows and columns run in reading order.
    """
    def side(c, name):
        first = pairs.select(key, F.posexplode(F.slice(c, 1, size)).alias(f"p{name}", "word"))
        return first.join(vectors, "word").join(idf, "word").select(
            key, f"p{name}", F.col("vector").alias(f"v{name}"), F.col("idf").alias(f"i{name}")
        )

    cells = side("a", "a").join(side("b", "b"), key)
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    cosine = dot("va", "vb") / F.sqrt(dot("va", "va") * dot("vb", "vb"))
    values = cells.select(key, (F.col("pa") * size + F.col("pb")).alias("at"), (cosine * F.col("ia") * F.col("ib")).alias("v"))
    filled = values.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("at", "v"))).alias("m"))
    grid = F.transform(F.sequence(F.lit(0), F.lit(size * size - 1)), lambda i: F.coalesce(F.col("m")[i], F.lit(0.0)))
    return pairs.select(key).join(filled, key, "left").select(key, grid.alias("grid"))
