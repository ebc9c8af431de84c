"""Streaming forms: running counts per field value, enrichment by static tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.aggregates import field_value_counts
from tessera.session import scratch_path


def read_events(spark: SparkSession, path: str, schema) -> DataFrame:
    """Stream of a Parquet file or folder; as a pattern, since a stream may not name one file."""
    path = path.rstrip("/")
    return spark.readStream.schema(schema).parquet(f"{path[:-1]}[{path[-1]}]")


def running_counts(stream: DataFrame, fields: Sequence[str], target: str) -> DataFrame:
    """Positive, negative and total per field value over everything seen so far.

    A batch writes only the values it changed, into a folder of its own, so a
    batch that is run again replaces itself. The last row of a value holds.
    """
    spark = stream.sparkSession
    out, log = scratch_path(spark, "counts"), scratch_path(spark, "counts-log")
    counts = field_value_counts(stream, fields, target, min_total=1)

    def put(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    counts.writeStream.outputMode("update").option("checkpointLocation", log).foreachBatch(put).trigger(
        availableNow=True
    ).start().awaitTermination()
    rows = spark.read.parquet(out)
    values = [c for c in rows.columns if c not in ("field", "value", "epoch")]
    latest = rows.groupBy("field", "value").agg(F.max_by(F.struct(*values), "epoch").alias("now"))
    return latest.select("field", "value", "now.*")


def enrich(stream: DataFrame, transform: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Join each arriving row with static tables and append the result."""
    spark = stream.sparkSession
    out, log = scratch_path(spark, "enriched"), scratch_path(spark, "enriched-log")
    transform(stream).writeStream.outputMode("append").format("parquet").option("path", out).option(
        "checkpointLocation", log
    ).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out)
