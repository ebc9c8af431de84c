"""Joins with a fixed meaning: natural, first match, default, membership, neighbours."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import cut_lineage, is_small


def natural_join(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    shared = [c for c in left.columns if c in right.columns]
    if not shared:
        raise ValueError("no common columns")
    return left.join(right, shared, how)


def first_match(left: DataFrame, right: DataFrame, on: str, value: str, order: str) -> DataFrame:
    """Left join taking the first row of each key by ``order``; no match gives null."""
    firsts = right.groupBy(on).agg(F.min_by(value, order).alias(value))
    return left.join(firsts, on, "left")


def lookup_with_default(left: DataFrame, dim: DataFrame, on: Sequence[str], defaults: Mapping) -> DataFrame:
    """Left join on a dimension with one row per key; missing rows get the defaults."""
    joined = left.join(dim, list(on), "left")
    return joined.select(
        [F.coalesce(F.col(c), F.lit(defaults[c])).alias(c) if c in defaults else F.col(c) for c in joined.columns]
    )


def listed_flag(
    left: DataFrame, lists: DataFrame, key: str, item: str, listing: str, out: str, sep: str = " "
) -> DataFrame:
    """1 when (key, item) appears in the separated list kept per key, else 0."""
    members = lists.select(key, F.explode(F.split(listing, sep)).alias(item)).distinct()
    members = members.withColumn("__in", F.lit(1))
    joined = left.join(members, [key, item], "left")
    return joined.withColumn(out, F.coalesce("__in", F.lit(0))).drop("__in")


def star_join(fact: DataFrame, tables: Sequence[tuple[DataFrame, Sequence[str]]]) -> DataFrame:
    """Left join feature tables, each with one row per key, onto a fact table."""
    out = fact
    for table, keys in tables:
        out = out.join(table, list(keys), "left")
    return out


def looked_up(
    rows: DataFrame, table: DataFrame, keys: Sequence[str], how: str = "left", parts: int | None = None
) -> DataFrame:
    """``rows`` joined with a table on keys without the user; with ``parts`` they stay dealt by user.

    The table is then written first, so that the planner knows its size and
    leaves the rows where they are if the table can go to every task.
    """
    if not parts:
        return rows.join(table, list(keys), how)
    table = cut_lineage(table)
    joined = rows.join(table, list(keys), how)
    return joined if is_small(table) else joined.repartition(parts, "user_id")


def lines_of(lines: DataFrame, orders: DataFrame, parts: int | None = None) -> DataFrame:
    """The lines whose order is among ``orders``; with ``parts`` they stay dealt by user."""
    wanted = orders.select("order_id")
    if not parts:
        return lines.join(wanted, "order_id", "left_semi")
    # only the orders of each user move, one row for all their lines
    own = lines.select("user_id", "order_id").distinct().join(wanted, "order_id", "left_semi")
    return lines.join(own.repartition(parts, "user_id"), ["user_id", "order_id"], "left_semi")


def shift_rows(df: DataFrame, keys: Sequence[str], step: str, by: int, columns: Sequence[str],
               suffix: str) -> DataFrame:
    """Columns as they were ``by`` steps earlier, keyed for an equi-join on (keys, step)."""
    return df.select(
        *keys, (F.col(step) + by).alias(step), *[F.col(c).alias(f"{c}{suffix}") for c in columns]
    )


def undirected(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Both directions of each pair once, without self-loops: (src, dst)."""
    one = pairs.select(F.col(a).alias("src"), F.col(b).alias("dst"))
    two = pairs.select(F.col(b).alias("src"), F.col(a).alias("dst"))
    return one.unionByName(two).where("src <> dst").distinct()


def common_neighbours(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Distinct pairs with the number of neighbours both ends share.

    The neighbours of the end with the lower degree are listed and looked up at
    the other end, so a hub costs no more than its partners' degrees.
    """
    edges = undirected(pairs, a, b)
    degree = edges.groupBy("src").agg(F.count(F.lit(1)).alias("deg"))
    wanted = pairs.select(a, b).distinct()
    sized = (
        wanted.join(degree.select(F.col("src").alias(a), F.col("deg").alias("__da")), a)
        .join(degree.select(F.col("src").alias(b), F.col("deg").alias("__db")), b)
    )
    small_a = F.col("__da") <= F.col("__db")
    oriented = sized.select(
        a, b,
        F.when(small_a, F.col(a)).otherwise(F.col(b)).alias("__low"),
        F.when(small_a, F.col(b)).otherwise(F.col(a)).alias("src"),
    )
    wedges = oriented.join(edges.select(F.col("src").alias("__low"), "dst"), "__low").drop("__low")
    closed = wedges.join(edges, ["src", "dst"], "left_semi")
    counted = closed.groupBy(a, b).agg(F.count(F.lit(1)).alias("common"))
    return wanted.join(counted, [a, b], "left").select(
        a, b, F.coalesce("common", F.lit(0)).cast("long").alias("common")
    )
