"""Connected components of an undirected edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import cut_lineage, release


def _star(pairs: DataFrame, keep) -> tuple[DataFrame, DataFrame]:
    """Hang the ``keep`` neighbours of every node u on the smallest node next to it (or u); and a table this reads."""
    # written before it is joined, so that Spark can split the neighbours of a hot node
    lowest = cut_lineage(pairs.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low")))
    return pairs.join(lowest, "u").where(keep).select(F.col("v").alias("u"), F.col("low").alias("v")), lowest


def _both(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def components(edges: DataFrame) -> DataFrame:
    """(u, v) edges of longs -> (node, component), the smallest node that can be reached.

    Alternates the large and the small star until nothing moves; each round is
    written to the shared folder. Every node that has an edge is listed.
    """
    edges = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    before, written = None, []
    while True:
        large, nearest = _star(_both(edges), F.col("v") > F.col("u"))
        small = large.where("u <> v").unionByName(
            large.groupBy("u").agg(F.min("v").alias("v")).where("u <> v")
        ).distinct()
        lowest = cut_lineage(small.groupBy("u").agg(F.min("v").alias("low")))
        hung = small.join(lowest, "u").select(F.col("v").alias("u"), F.col("low").alias("v"))
        edges = cut_lineage(hung.unionByName(lowest.select("u", F.col("low").alias("v"))).where("u <> v").distinct())
        release(nearest, lowest, *written)
        written = [edges]
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return edges.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node").unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
