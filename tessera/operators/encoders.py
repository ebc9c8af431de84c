"""Encoders, sparse text weights, scalers and projections."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.ml import Pipeline
from pyspark.ml.feature import (
    PCA, Interaction, VectorAssembler, Word2Vec,
)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.ranges import dense_codes, group_quantiles, split_window
from tessera.operators.topk import top_n
from tessera.session import cut_lineage


def hash_bucket(key: Column, size: int) -> Column:
    """Bucket 0 .. size-1 from the first 15 hex digits (60 bits) of the key's md5; the same in any engine."""
    return F.conv(F.substring(F.md5(key.cast("string")), 1, 15), 16, 10).cast("long") % size


def label_codes(frames: Sequence[DataFrame], column: str, out: str) -> DataFrame:
    """Code table from 0 in ascending order, fitted on all frames together."""
    stacked = frames[0].select(column)
    for df in frames[1:]:
        stacked = stacked.unionByName(df.select(column))
    return dense_codes(stacked, column, out, start=0)


def column_levels(df: DataFrame, column: str, min_count: int = 1) -> list:
    """Values of a column seen often enough; they become columns, so the driver has to know them."""
    rows = (
        df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") >= min_count).select(column).collect()
    )
    return sorted(r[0] for r in rows)


def one_hot(df: DataFrame, columns: Sequence[str], min_count: int = 1) -> list[Column]:
    """0/1 columns for the values of each column. ``sparse_one_hot`` keeps levels off the driver."""
    return [
        F.coalesce((F.col(c) == F.lit(v)).cast("int"), F.lit(0)).alias(f"{c}_{v}")
        for c in columns for v in column_levels(df, c, min_count)
    ]


def few_valued(df: DataFrame, columns: Sequence[str], low: int = 3, high: int = 6) -> list[str]:
    """Columns with between ``low`` and ``high`` distinct values."""
    counts = df.agg(*[F.count_distinct(c).alias(c) for c in columns]).first()
    return [c for c in columns if low <= counts[c] <= high]


def _coded(cells: DataFrame, block: str, term: str, kept: DataFrame) -> DataFrame:
    """(key columns, slot, value): ``kept`` (block, term) pairs numbered from 0 in their order, joined to the cells."""
    codes = split_window(kept.select(block, term), [], [block, term], row_number="__r").withColumn("slot", F.col("__r") - 1)
    # sorted by term first: a block is one of a few values, by which a sort hardly tells rows apart
    return cells.join(codes.drop("__r"), [term, block]).drop(block, term)


def sparse_one_hot(df: DataFrame, key: str, columns: Sequence[str], min_count: int = 1) -> DataFrame:
    """(key, slot, value) cells of the one-hot block: a slot per column and value, columns in the given order."""
    place = F.array(*[
        F.struct(F.lit(i).alias("field"), F.col(c).cast("string").alias("term")) for i, c in enumerate(columns)
    ])
    cells = df.select(key, F.explode(place).alias("c")).select(key, "c.*").where("term is not null")
    kept = cells.groupBy("field", "term").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count)
    return _coded(cells, "field", "term", kept).select(key, "slot", F.lit(1.0).alias("value"))


def count_vectors(grams: DataFrame, key: str, n: str, gram: str, min_df: int = 1) -> DataFrame:
    """(key, slot, value) cells of a bag of grams, from one row (key, gram length, gram) per occurrence.

    Slots run over gram lengths and then grams; grams in fewer than ``min_df`` texts have none.
    Grams of texts that are dealt by ``key`` before they are cut are counted where they lie.
    """
    counts = grams.groupBy(key, n, gram).agg(F.count(F.lit(1)).cast("double").alias("value"))
    # written once: numbering the grams reads them several times
    kept = cut_lineage(counts.groupBy(n, gram).agg(F.count(F.lit(1)).alias("df")).where(F.col("df") >= min_df))
    return _coded(counts, n, gram, kept).select(key, "slot", "value")


def numeric_block(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """(key, slot, value) cells of numeric columns, a slot each."""
    cells = F.array(*[F.struct(F.lit(i).cast("long").alias("slot"), F.col(c).cast("double").alias("value")) for i, c in enumerate(columns)])
    return df.select(key, F.explode(cells).alias("c")).select(key, "c.slot", "c.value").where("value is not null")


def stacked_blocks(blocks: Sequence[DataFrame]) -> DataFrame:
    """Blocks of (key, slot, value) cells side by side: each starts after the last slot of the one before."""
    out, start = None, F.lit(0).cast("long")
    for block in blocks:
        moved = block.withColumn("slot", F.col("slot") + start)
        out = moved if out is None else out.unionByName(moved)
        start = start + F.coalesce(block.agg(F.max("slot") + 1).scalar(), F.lit(0))
    return out


def design_matrix(df: DataFrame, key: str, numeric: Sequence[str], factors: Sequence[str]) -> DataFrame:
    """(key, slot, value) cells of a design matrix: numeric columns, then all but the first level of each factor."""
    place = F.array(*[F.struct(F.lit(i).alias("field"), F.col(c).cast("string").alias("term")) for i, c in enumerate(factors)])
    cells = df.select(key, F.explode(place).alias("c")).select(key, "c.*").where("term is not null")
    levels = cells.select("field", "term").distinct()
    first = levels.groupBy("field").agg(F.min("term").alias("term"))
    kept = levels.join(first, ["field", "term"], "left_anti")
    return stacked_blocks([numeric_block(df, key, numeric), _coded(cells, "field", "term", kept).select(key, "slot", F.lit(1.0).alias("value"))])


def char_gram_rows(df: DataFrame, key: str, text: str, low: int, high: int) -> DataFrame:
    """(key, term) of each character gram of ``low`` to ``high`` characters; each place of a text is read once."""
    starts = F.explode(F.sequence(F.lit(1), F.length(text) - (low - 1))).alias("at")
    places = df.where(F.length(text) >= low).select(key, text, starts)
    pieces = places.select(key, F.substring(text, F.col("at"), F.lit(high)).alias("piece"))
    sizes = F.explode(F.array(*[F.lit(n) for n in range(low, high + 1)])).alias("n")
    return pieces.select(key, "piece", sizes).where(F.length("piece") >= F.col("n")).select(
        key, F.substring("piece", F.lit(1), F.col("n")).alias("term")
    )


def tfidf(terms: DataFrame, key: str, term: str, sublinear: bool = True, min_df: int = 1,
          max_features: int | None = None, texts: Column | None = None) -> DataFrame:
    """Length-1 TF-IDF rows (key, term, value) from one row per occurrence.

    tf is 1 + ln(count) when sublinear; idf = ln((1 + texts) / (1 + texts with the
    term)) + 1; ``max_features`` keeps the terms with most occurrences. ``texts`` is the
    number of texts with a term, counted here unless given. Texts that are dealt by ``key``
    before they are cut into terms are counted and scaled where they lie.
    """
    if texts is None:
        texts = terms.agg(F.count_distinct(key)).scalar()
    if max_features and min_df <= 1:
        # the most frequent terms are known without the texts: the others are never counted per text
        totals = terms.groupBy(term).agg(F.count(F.lit(1)).alias("total"))
        kept = cut_lineage(top_n(totals, [F.col("total").desc(), F.col(term)], max_features).select(term))
        counts = cut_lineage(terms.join(kept, term, "left_semi").groupBy(key, term).agg(F.count(F.lit(1)).alias("tf")))
        stats = counts.groupBy(term).agg(F.count(F.lit(1)).alias("df"))
    else:
        counts = terms.groupBy(key, term).agg(F.count(F.lit(1)).alias("tf"))
        stats = counts.groupBy(term).agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total")).where(F.col("df") >= min_df)
        if max_features:
            stats = cut_lineage(top_n(stats, [F.col("total").desc(), F.col(term)], max_features))
    idf = stats.select(term, (F.log((1 + texts) / (1 + F.col("df"))) + 1).alias("idf"))
    weight = (1 + F.log("tf")) if sublinear else F.col("tf")
    weighted = counts.where(F.col(key).isNotNull()).join(idf, term).select(key, term, (weight * F.col("idf")).alias("w"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(key)))
    return weighted.select(key, term, (F.col("w") / norm).alias("value"))


def hashed_bag(df: DataFrame, key: str, grams: Sequence[tuple[Column, float]], size: int) -> DataFrame:
    """(key, slot, value): each distinct gram adds the weight of its length to its hash slot."""
    def weighted(g, w):
        return F.transform(F.array_distinct(g), lambda x: F.struct(x.alias("g"), F.lit(float(w)).alias("w")))

    tagged = F.flatten(F.array(*[weighted(g, w) for g, w in grams]))
    return df.select(key, F.explode(tagged).alias("t")).groupBy(key, hash_bucket(F.col("t.g"), size).alias("slot")).agg(
        F.sum("t.w").alias("value")
    )


def hashed_fields(columns: Sequence[str], size: int, interactions: bool = True) -> Column:
    """Hash slots of ``column_value`` terms and, optionally, of all their pairs."""
    terms = [F.concat_ws("_", F.lit(c), F.col(c).cast("string")) for c in columns]
    if interactions:
        terms += [F.concat_ws("_", terms[i], terms[j]) for i in range(len(columns)) for j in range(i + 1, len(columns))]
    return F.array(*[hash_bucket(t, size) for t in terms])


def drop_rare_terms(terms: DataFrame, key: str, term: str, min_df: int = 2) -> DataFrame:
    """Rows whose term occurs in at least ``min_df`` texts."""
    kept = terms.select(key, term).distinct().groupBy(term).agg(F.count(F.lit(1)).alias("df")).where(F.col("df") >= min_df)
    return terms.join(kept.select(term), term, "left_semi")


def column_quantiles(df: DataFrame, columns: Sequence[str], quantiles: Mapping[str, float]) -> dict[str, dict[str, float]]:
    """Exact quantiles of many columns in one pass; the driver gets one row per column."""
    long = df.select([F.col(c).cast("double").alias(c) for c in columns]).unpivot([], list(columns), "column", "v")
    rows = group_quantiles(long, ["column"], "v", quantiles).collect()
    return {r["column"]: {q: r[q] for q in quantiles} for r in rows}


def robust_scaled(df: DataFrame, columns: Sequence[str]) -> list[Column]:
    """(x - median) / (third quartile - first quartile); a zero range divides by one."""
    q = column_quantiles(df, columns, {"low": 0.25, "mid": 0.5, "high": 0.75})
    return [((F.col(c) - q[c]["mid"]) / ((q[c]["high"] - q[c]["low"]) or 1.0)).alias(c) for c in columns]


def min_max_scaled(df: DataFrame, columns: Sequence[str]) -> list[Column]:
    ends = df.agg(*[f(c).alias(f"{c}_{n}") for c in columns for n, f in (("low", F.min), ("high", F.max))]).first()
    return [
        ((F.col(c) - ends[f"{c}_low"]) / ((ends[f"{c}_high"] - ends[f"{c}_low"]) or 1.0)).alias(c) for c in columns
    ]


def project(vector: Column, matrix: np.ndarray) -> Column:
    """Row vector (array) times a small dense matrix, as an array."""
    def dot(weights):
        w = F.array(*[F.lit(float(x)) for x in weights])
        return F.aggregate(F.zip_with(vector, w, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)

    return F.array(*[dot(matrix[:, j]) for j in range(matrix.shape[1])])


def pca_matrix(df: DataFrame, vector: str, k: int) -> np.ndarray:
    """Principal directions (columns) of an array column; projection is not centred."""
    rows = df.select(array_to_vector(F.col(vector).cast("array<double>")).alias("v"))
    return PCA(k=k, inputCol="v", outputCol="o").fit(rows).pc.toArray()


def svd_matrix(df: DataFrame, vector: str, k: int) -> np.ndarray:
    """Leading right singular vectors (columns) of an array column."""
    rows = df.select(array_to_vector(F.col(vector).cast("array<double>")).alias("v"))
    return RowMatrix(MLUtils.convertVectorColumnsFromML(rows, "v")).computeSVD(k).V.toArray()


def gaussian_matrix(d: int, k: int, seed: int) -> np.ndarray:
    return np.random.RandomState(seed).normal(0.0, 1.0 / np.sqrt(k), (d, k))


def sparse_matrix(d: int, k: int, seed: int) -> np.ndarray:
    """Random signs with density 1/sqrt(d)."""
    density = 1 / np.sqrt(d)
    rng = np.random.RandomState(seed)
    return rng.choice([-1.0, 0.0, 1.0], (d, k), p=[density / 2, 1 - density, density / 2]) / np.sqrt(density * k)


def item_vectors(baskets: DataFrame, items: str, size: int = 16, min_count: int = 1, seed: int = 7,
                 partitions: int = 8) -> DataFrame:
    """Word2Vec vectors of basket items with their two leading components: (word, vector, x, y)."""
    model = Word2Vec(vectorSize=size, minCount=min_count, inputCol=items, outputCol="v", seed=seed,
                     numPartitions=partitions, maxIter=1).fit(baskets)
    vectors = model.getVectors()
    flat = PCA(k=2, inputCol="vector", outputCol="p").fit(vectors).transform(vectors)
    p = vector_to_array("p")
    return flat.select("word", vector_to_array("vector").alias("vector"), p[0].alias("x"), p[1].alias("y"))


def leaf_indices(df: DataFrame, features: str, label: str, trees: int = 5, depth: int = 3, seed: int = 7) -> DataFrame:
    """Leaf reached in each tree of a boosted forest, as an array column ``leaves``."""
    model = GBTRegressor(featuresCol=features, labelCol=label, maxIter=trees, maxDepth=depth, seed=seed, leafCol="leaf").fit(df)
    return model.transform(df).withColumn("leaves", vector_to_array("leaf").cast("array<int>")).drop("leaf", "prediction")


def interactions(df: DataFrame, columns: Sequence[str], out: str) -> DataFrame:
    """Products of all pairs of columns as one vector."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1:]]
    stages = [Interaction(inputCols=[a, b], outputCol=f"{a}:{b}") for a, b in pairs]
    stages.append(VectorAssembler(inputCols=[f"{a}:{b}" for a, b in pairs], outputCol=out))
    return Pipeline(stages=stages).fit(df).transform(df).drop(*[f"{a}:{b}" for a, b in pairs])
