"""Feature matrices: listings, and wide rows with projections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import FeatureHasher, HashingTF, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.functions.rules import QUESTION_STOP_WORDS
from tessera.operators import encoders as E
from tessera.operators.frames import split_path
from tessera.operators.ranges import dense_codes
from tessera.operators.topk import keep_frequent
from tessera.session import cut_lineage


PARTS = ["general_cat", "subcat_1", "subcat_2"]
FIELDS = ["brand", *PARTS, "condition"]


def prepared_listings(df: DataFrame, brands: int = 4000, categories: int = 1000) -> DataFrame:
    """Category (``a/b/c``) split, rare brands and categories to ``missing``, words of name and description."""
    out = df.select("*", *split_path(F.col("category"), "/", PARTS, ["missing"] * 3)).fillna("missing", ["brand"])
    out = keep_frequent(out, "brand", brands, "missing")
    for c in PARTS:
        out = keep_frequent(out, c, categories, "missing")
    return out.withColumn("name_words", X.normal_words("name", QUESTION_STOP_WORDS)).withColumn(
        "description_words", X.normal_words(X.fill_missing("description", "missing", ["No description yet"]), QUESTION_STOP_WORDS)
    )


def _grams(df: DataFrame, key: str, words: str, sizes: Sequence[int]) -> DataFrame:
    each = F.array(*[F.struct(F.lit(n).alias("n"), X.word_ngrams(F.col(words), n, " ").alias("g")) for n in sizes])
    rows = df.select(key, F.explode(each).alias("x"))
    return rows.select(key, F.col("x.n").alias("n"), F.explode("x.g").alias("gram"))


def listing_cells(df: DataFrame, key: str, min_df: int = 2, max_features: int = 50_000) -> DataFrame:
    """The stacked matrix of prepared listings as (key, slot, value) cells.

    Blocks: one-hot fields, counts of the name's 1- and 2-grams found in
    ``min_df`` names, TF-IDF of the ``max_features`` most frequent 1- to
    3-grams of the description.
    """
    weights = E.tfidf(_grams(df, key, "description_words", (1, 2, 3)), key, "gram", sublinear=False, max_features=max_features)
    weights = cut_lineage(weights)
    blocks = [
        E.sparse_one_hot(df, key, FIELDS),
        E.count_vectors(_grams(df, key, "name_words", (1, 2)), key, "n", "gram", min_df),
        weights.join(dense_codes(weights, "gram", "slot", start=0), "gram").select(key, "slot", "value"),
    ]
    return E.stacked_blocks([cut_lineage(b) for b in blocks])


def hashed_listings(df: DataFrame, size: int = 1 << 16) -> DataFrame:
    """Prepared listings with fields and name words hashed into one sparse vector ``features``."""
    fields = FeatureHasher(inputCols=FIELDS, outputCol="__fields", numFeatures=size).transform(df)
    both = HashingTF(inputCol="name_words", outputCol="__words", numFeatures=size).transform(fields)
    return VectorAssembler(inputCols=["__fields", "__words"], outputCol="features").transform(both).drop("__fields", "__words")


def projected_rows(df: DataFrame, key: str, vector: str, categories: Sequence[str], k: int = 12, seed: int = 7) -> DataFrame:
    """Label codes of the categories, and PCA, SVD and two random projections of the vector."""
    width = len(df.select(vector).first()[0])
    numeric = df.withColumn("__v", F.col(vector).cast("array<double>"))
    v = F.col("__v")
    out = numeric.select(
        key, *categories,
        E.project(v, E.pca_matrix(df, vector, k)).alias("pca"), E.project(v, E.svd_matrix(df, vector, k)).alias("svd"),
        E.project(v, E.gaussian_matrix(width, k, seed)).alias("grp"), E.project(v, E.sparse_matrix(width, k, seed)).alias("srp"),
    )
    for c in categories:
        out = out.join(E.label_codes([df], c, f"{c}_code"), c, "left")
    return out
