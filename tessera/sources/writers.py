"""Sinks: delimited files with fixed decimals, line formats for sparse learners, vocabularies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.ranges import split_window


def write_delimited(df: DataFrame, path: str, sep: str = ",", decimals: int | None = None, header: bool = True) -> None:
    """CSV sink; ``decimals`` fixes the digits after the point of floating columns."""
    if decimals is not None:
        df = df.select([
            F.format_string(f"%.{decimals}f", c).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes
        ])
    df.write.option("header", header).option("sep", sep).csv(path)


def materialise(df: DataFrame, path: str) -> DataFrame:
    """Write a stage's result and read it back."""
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def svmlight_lines(rows: DataFrame, key: str, label: str, index: str, value: str) -> DataFrame:
    """``label idx:val ...`` per key, indices ascending and distinct, from (key, label, index, value) rows."""
    # dealt once by key: duplicates are dropped and lines put together where the cells then lie
    cells = rows.select(key, label, index, value).repartition(key).dropDuplicates([key, index])
    items = F.sort_array(F.collect_list(F.struct(F.col(index).alias("i"), F.col(value).alias("v"))))
    text = F.array_join(F.transform(items, lambda x: F.format_string("%d:%.6f", x["i"], x["v"])), " ")
    return cells.groupBy(key, label).agg(text.alias("t")).select(
        key, F.concat_ws(" ", F.col(label).cast("string"), "t").alias("line")
    )


def ffm_index(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Feature numbers from 0: the values of each column in order, then the column itself."""
    values = df.select([F.col(c).cast("string").alias(c) for c in columns]).unpivot([], list(columns), "field", "value")
    entries = values.where("value IS NOT NULL").distinct().withColumn("kind", F.lit(0))
    own = df.sparkSession.createDataFrame([(c, "", 1) for c in columns], "field string, value string, kind int")
    ranked = split_window(entries.unionByName(own), [], ["field", "kind", "value"], row_number="n")
    return ranked.select("field", "kind", "value", (F.col("n") - 1).alias("feature"))


def ffm_lines(df: DataFrame, key: str, label: str, categorical: Sequence[str], numeric: Sequence[str]) -> DataFrame:
    """``y field:feature:1`` for categories and ``field:feature:value`` for numbers, fields by name."""
    columns = sorted([*categorical, *numeric])
    index = ffm_index(df, columns)
    out = df
    for c in categorical:
        codes = index.where((F.col("field") == c) & (F.col("kind") == 0)).select(
            F.col("value").alias(f"__v_{c}"), F.col("feature").alias(f"__f_{c}")
        )
        out = out.join(codes, F.col(c).cast("string") == F.col(f"__v_{c}"), "left")
    for c in numeric:
        own = index.where((F.col("field") == c) & (F.col("kind") == 1)).select("feature")
        out = out.withColumn(f"__f_{c}", own.scalar())
    terms = []
    for i, c in enumerate(columns):
        value = F.lit("1") if c in categorical else F.col(c).cast("string")
        terms.append(F.when(F.col(c).isNotNull(), F.concat_ws(":", F.lit(str(i)), F.col(f"__f_{c}").cast("string"), value)))
    return out.select(key, F.concat_ws(" ", F.col(label).cast("string"), *terms).alias("line"))


def vocabulary(df: DataFrame, columns: Sequence[str], min_count: int = 10) -> DataFrame:
    """``column_value`` features seen at least ``min_count`` times."""
    long = df.select([F.col(c).cast("string").alias(c) for c in columns]).unpivot([], list(columns), "field", "value")
    return long.groupBy(F.concat_ws("_", "field", "value").alias("feature")).agg(F.count(F.lit(1)).alias("n")).where(
        F.col("n") >= min_count
    )
