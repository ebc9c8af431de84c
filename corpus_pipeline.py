"""A corpus pipeline of five stages, each over all rows its predecessor kept.

Every stage takes (spark, docs, sf_dir) and gives a DataFrame; ``run`` writes
it as Parquet in the shared folder and reads it back for the next stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import decontaminate, jaccard, mixing, quality, sharding
from tessera.llm.words import configure_for_texts
from tessera.session import cut_lineage


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what the quality rules reject."""
    configure_for_texts(spark)
    trusted = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1").select("doc_id")
    return quality.keep_good(docs, quality.fit_ratio(docs, trusted))


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the first document of each group of 5-word shingle sets that link at 0.8."""
    configure_for_texts(spark)
    return jaccard.keep_first(docs, size=5, percent=80, pivots="single")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item."""
    configure_for_texts(spark)
    return decontaminate.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Draw the mix; a document taken twice is in it twice."""
    configure_for_texts(spark)
    return mixing.mixed_rows(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deal the records to eight shards of nearly equal bytes."""
    configure_for_texts(spark)
    return sharding.range_shards(docs)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("jaccard_join", jaccard_join),
    ("decontamination", decontamination),
    ("mix_sources", mix_sources),
    ("shard", shard),
]

# the hashed n-gram model, and with it all that follows, has no SQL form
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return docs
