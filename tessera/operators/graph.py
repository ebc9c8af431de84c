"""Core numbers of an undirected graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.joins import undirected
from tessera.session import cut_lineage


def core_numbers(pairs: DataFrame, a: str, b: str, top: int = 20) -> DataFrame:
    """Largest k up to ``top`` for which a node is in the k-core; 0 when in no 2-core.

    Each node starts at its degree and repeatedly takes the largest k such that
    at least k neighbours hold k or more; the values fall to the core numbers.
    A node keeps how many neighbours hold 1 or more, 2 or more, ... up to ``top``.
    After the first round only the edges of nodes that moved are read: they lower
    the counters of their other ends. The rounds end when nothing moves.
    """
    edges = cut_lineage(undirected(pairs, a, b))
    start = edges.groupBy("src").agg(F.least(F.count(F.lit(1)), F.lit(top)).alias("k"))
    # a neighbour that holds v counts for 1, ..., v
    held = edges.join(start.select(F.col("src").alias("dst"), F.col("k").alias("kd")), "dst").groupBy("src").agg(
        *[F.count_if(F.col("kd") >= k).alias(f"n{k}") for k in range(1, top + 1)]
    )
    counters = [f"n{k}" for k in range(1, top + 1)]
    state = cut_lineage(_settled(start.join(held, "src"), top))
    while True:
        moved = state.where("k < was").select(F.col("src").alias("dst"), "k", "was")
        fewer = lowered(edges, moved, top)
        if fewer is None:
            return state.select(F.col("src").alias("node"), F.when(F.col("k") >= 2, F.col("k")).otherwise(0).alias("core"))
        less = [(F.col(c) - F.coalesce(F.col(f"__{c}"), F.lit(0))).alias(c) for c in counters]
        state = cut_lineage(_settled(state.join(fewer, "src", "left").select("src", "k", *less), top))


def _settled(state: DataFrame, top: int) -> DataFrame:
    """(src, k, counters) -> the k that the counters allow, and what it was."""
    best = F.greatest(F.lit(0), *[F.when(F.col(f"n{k}") >= k, k).otherwise(0) for k in range(1, top + 1)])
    return state.select(
        "src", F.least("k", best.cast("long")).alias("k"), F.col("k").alias("was"), *[f"n{k}" for k in range(1, top + 1)]
    )


def lowered(edges: DataFrame, moved: DataFrame, top: int) -> DataFrame | None:
    """By how much the counters of the other ends of moved nodes (dst, k, was) fall; None if none moved."""
    if moved.isEmpty():
        return None
    falls = [F.count_if((F.col("k") < j) & (F.col("was") >= j)).alias(f"__n{j}") for j in range(1, top + 1)]
    return edges.join(moved, "dst").groupBy("src").agg(*falls)
