"""Scans of delimited, dictionary and vector text files. Schemas are always declared."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_delimited(
    spark: SparkSession, path: str | Sequence[str], schema: StructType | str, *, sep: str = ",",
    quoted: bool = True, null_value: str | None = None, columns: Sequence[str] | None = None,
    source_column: str | None = None,
) -> DataFrame:
    """CSV or TSV with a header. ``source_column`` keeps the name of the file a row came from."""
    reader = spark.read.schema(schema).option("header", True).option("sep", sep)
    if not quoted:
        reader = reader.option("quote", "")
    if null_value is not None:
        reader = reader.option("nullValue", null_value)
    df = reader.csv(path)
    if columns is not None:
        df = df.select(*columns)
    if source_column:
        df = df.withColumn(source_column, F.element_at(F.split(F.input_file_name(), "/"), -1))
    return df


def read_bounded(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    """The first ``n`` rows by an explicit order; a file has none of its own."""
    return df.orderBy(*order).limit(n)


def read_key_values(spark: SparkSession, path: str, sep: str = "->") -> DataFrame:
    """Lines ``key->value`` as two columns."""
    parts = F.split(F.rtrim("value"), F.lit(sep))
    return spark.read.text(path).where(F.size(parts) == 2).select(parts[0].alias("key"), parts[1].alias("value"))


def read_word_vectors(spark: SparkSession, path: str) -> DataFrame:
    """Lines ``word f1 ... fd`` as (word, vector)."""
    parts = F.split(F.rtrim("value"), " ")
    return spark.read.text(path).select(
        parts[0].alias("word"), F.slice(parts, F.lit(2), F.size(parts) - 1).cast("array<float>").alias("vector")
    )


def null_sentinels(df: DataFrame, value, columns: Sequence[str]) -> DataFrame:
    """Turn a sentinel such as -1 into null."""
    return df.select([F.nullif(c, F.lit(value)).alias(c) if c in columns else F.col(c) for c in df.columns])
