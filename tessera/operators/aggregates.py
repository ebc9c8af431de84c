"""Grouped summaries. All combine partial results before the shuffle."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import bound
from tessera.operators.ranges import LARGE
from tessera.session import cut_lineage

# column sets of no more groups are counted apart and joined back
_FEW_GROUPS = 1 << 16


def mode_per_key(df: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """Most frequent value per key; the lowest value wins a tie."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__n"))
    return counts.groupBy(*keys).agg(F.min_by(value, F.struct(-F.col("__n"), F.col(value))).alias(out))


def mode_position(df: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """1-based place of the mode among the key's distinct values."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__n"))
    modes = counts.groupBy(*keys).agg(
        F.min_by(value, F.struct(-F.col("__n"), F.col(value))).alias("__mode")
    )
    return (
        counts.join(modes, list(keys))
        .groupBy(*keys)
        .agg(F.count_if(F.col(value) <= F.col("__mode")).alias(out))
    )


def group_counts(df: DataFrame, groups: Sequence[Sequence[str]]) -> dict[tuple[str, ...], DataFrame]:
    """``count(*)`` of each column set, all from one pass over ``df``: column set -> (columns, n)."""
    keys = list(dict.fromkeys(c for cols in groups for c in cols))
    sets = [[F.col(c) for c in cols] for cols in groups]
    counts = cut_lineage(
        df.groupingSets(sets, *keys).agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("__set"))
    )
    out = {}
    for cols in groups:
        absent = sum(1 << (len(keys) - 1 - i) for i, c in enumerate(keys) if c not in cols)
        out[tuple(cols)] = counts.where(F.col("__set") == absent).select(*cols, "n")
    return out


def with_group_counts(
    df: DataFrame, groups: Mapping[str, Sequence[str]], values: Mapping[tuple[str, ...], DataFrame] | None = None
) -> DataFrame:
    """Add ``count(*)`` of each column set as a column.

    A set is counted where the rows of its finest column lie together: the rows are shuffled once
    for each such column, not once for each set, and sorted once for each chain of sets that are
    prefixes of each other. Sets of few groups, and sets whose columns all have a value of more
    than ``LARGE`` rows, are counted in one pass and joined back. ``values`` are the ``group_counts``
    of every single column, if the caller has them. Reads ``df`` up to three times.
    """
    columns = list(dict.fromkeys(c for cols in groups.values() for c in cols))
    values = values or group_counts(df, [[c] for c in columns])
    sizes = {c: values[(c,)].agg(F.coalesce(F.max("n"), F.lit(0)), F.count(F.lit(1))).first() for c in columns}
    largest, distinct = ({c: size[i] for c, size in sizes.items()} for i in (0, 1))
    finest = {name: min(cols, key=lambda c: (largest[c], -distinct[c])) for name, cols in groups.items()}
    joined = {
        name: cols for name, cols in groups.items()
        if largest[finest[name]] > LARGE or math.prod(distinct[c] for c in cols) <= _FEW_GROUPS
    }
    out = df
    if joined:
        counts = group_counts(df, list(joined.values()))
        for name, cols in joined.items():
            table = counts[tuple(cols)].select(*[F.col(c).alias(f"__g_{c}") for c in cols], F.col("n").alias(name))
            same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"__g_{c}")) for c in cols])
            out = out.join(table, same, "left").drop(*[f"__g_{c}" for c in cols])
    for hub in dict.fromkeys(finest[name] for name in groups if name not in joined):
        out = out.repartition(hub)
        held = {n: [hub, *[c for c in groups[n] if c != hub]] for n in groups if n not in joined and finest[n] == hub}
        for chain in _chains(held):
            # the longest order also serves the sets before it
            out = out.sortWithinPartitions(*chain[-1][1])
            for name, cols in chain:
                out = out.select("*", F.count(F.lit(1)).over(Window.partitionBy(*cols)).alias(name))
    return out.select(*df.columns, *groups)


def _chains(sets: Mapping[str, Sequence[str]]) -> list[list[tuple[str, Sequence[str]]]]:
    """Named column lists as chains in which each list holds the columns of the one before, in that order."""
    chains = []
    for name, cols in sorted(sets.items(), key=lambda s: -len(s[1])):
        for chain in chains:
            last = chain[0][1]
            if set(cols) < set(last):
                # the shorter set's columns come first in every longer one
                chain[:] = [(name, list(cols)), *[(n, [*cols, *[c for c in longer if c not in cols]]) for n, longer in chain]]
                break
        else:
            chains.append([(name, list(cols))])
    return chains


def with_group_max(df: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    return df.join(df.groupBy(*keys).agg(F.max(value).alias(out)), list(keys))


def second_highest(df: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """Second-highest distinct value per key, 0 when there is none."""
    top = Window.partitionBy(*keys).orderBy(F.col(value).desc())
    two = df.select(*keys, value).distinct().withColumn("__r", F.row_number().over(top)).where("__r <= 2")
    return two.groupBy(*keys).agg(
        F.coalesce(F.max(F.when(F.col("__r") == 2, F.col(value))), F.lit(0)).alias(out)
    )


def parent_share(df: DataFrame, parent: str, child: str) -> DataFrame:
    """Rows and distinct users of a child within its parent, and their shares."""
    lines = df.groupBy(parent, child).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("users")
    )
    above = df.groupBy(parent).agg(
        F.count(F.lit(1)).alias("parent_n"), F.count_distinct("user_id").alias("parent_users")
    )
    return lines.join(above, parent).select(
        parent, child, "n", "parent_n", (F.col("n") / F.col("parent_n")).alias("n_ratio"),
        "users", "parent_users", (F.col("users") / F.col("parent_users")).alias("users_ratio"),
    )


def repeat_buyers(df: DataFrame, key: str) -> DataFrame:
    """Distinct users who reordered, per key, and their share of the key's users."""
    per_user = df.groupBy(key, "user_id").agg(F.max("reordered").alias("again"))
    return per_user.groupBy(key).agg(
        F.sum("again").alias("repeat_users"), F.avg("again").alias("repeat_ratio")
    ).where("repeat_users > 0")


def purchase_counts(lines: DataFrame) -> DataFrame:
    """Lines and reorders per (user, product): the base of most product summaries."""
    return lines.groupBy("user_id", "product_id").agg(
        F.count(F.lit(1)).alias("times"), F.sum("reordered").alias("again")
    )


def reorder_stats(lines: DataFrame, prefix: str = "prod_") -> DataFrame:
    """Orders, reorders, probability of a second purchase, times and ratio per product."""
    firsts = F.count(F.lit(1))
    return purchase_counts(lines).groupBy("product_id").agg(
        F.sum("times").alias(f"{prefix}orders"),
        firsts.alias(f"{prefix}user"),
        F.sum("again").alias(f"{prefix}reorders"),
        (F.count_if(F.col("times") >= 2) / firsts).alias(f"{prefix}reorder_probability"),
        (1 + F.sum("again") / firsts).alias(f"{prefix}reorder_times"),
        (F.sum("again") / F.sum("times")).alias(f"{prefix}reorder_ratio"),
    )


def hierarchical_means(df: DataFrame, value: str, levels: Mapping[str, Sequence[str]]) -> dict[str, DataFrame]:
    """Mean of ``value`` at each level; an empty key list is the overall mean."""
    return {name: df.groupBy(*cols).agg(F.avg(value).alias(name)) for name, cols in levels.items()}


def smoothed_rate(df: DataFrame, key: str, target: str, weight: float, out: str) -> DataFrame:
    """(sum of target + weight x overall rate) / (rows + weight) per key."""
    prior = df.agg(F.avg(target)).scalar()
    return df.groupBy(key).agg(
        F.sum(target).alias("hits"), F.count(F.lit(1)).alias("n")
    ).select(key, ((F.col("hits") + weight * prior) / (F.col("n") + weight)).alias(out))


def target_encoding(fit: DataFrame, column: str, target: str, out: str, min_samples: float = 1.0,
                    smoothing: float = 1.0) -> DataFrame:
    """Sigmoid-smoothed mean of the target per value, fitted on ``fit`` only."""
    prior = fit.agg(F.avg(target)).scalar()
    weight = 1 / (1 + F.exp(-(F.col("__n") - min_samples) / smoothing))
    return fit.groupBy(column).agg(F.avg(target).alias("__m"), F.count(target).alias("__n")).select(
        column, (prior * (1 - weight) + F.col("__m") * weight).alias(out)
    )


def apply_target_encoding(df: DataFrame, table: DataFrame, column: str, out: str, prior: Column) -> DataFrame:
    joined = df.join(table, column, "left")
    return joined.withColumn(out, F.coalesce(F.col(out), prior))


def field_value_counts(df: DataFrame, fields: Sequence[str], target: str, min_total: int = 10) -> DataFrame:
    """Positive, negative and total rows per (field, value), with the positive share."""
    long = df.select(target, *[F.col(f).cast("string").alias(f) for f in fields]).unpivot(
        [target], list(fields), "field", "value"
    )
    return (
        long.groupBy("field", "value")
        .agg(
            F.count_if(F.col(target) == 1).alias("pos"),
            F.count_if(F.col(target) == 0).alias("neg"),
            F.count(F.lit(1)).alias("total"),
        )
        .where(F.col("total") >= min_total)
        .withColumn("ratio", F.col("pos") / F.col("total"))
    )


def class_odds(df: DataFrame, a: str, b: str, target: str) -> DataFrame:
    """Contingency of a value pair against a 0/1 target, with the odds of each cell."""
    return df.groupBy(a, b).agg(
        F.count_if(F.col(target) == 0).alias("n0"), F.count_if(F.col(target) == 1).alias("n1")
    ).withColumn("odds", F.try_divide(F.col("n1"), F.col("n0")))


def skewness_corrected(c: str) -> Column:
    """Skewness with the sample-size correction."""
    n = F.count(c)
    return F.skewness(c) * F.sqrt((n * (n - 1)).cast("double")) / (n - 2)


def word_counts(df: DataFrame, tokens: Column) -> DataFrame:
    return df.select(F.explode(tokens).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def log_count_ratio(df: DataFrame, token: str, label: str, alpha: float = 1.0) -> DataFrame:
    """log share of a token in class 1 minus log share in class 0, add-alpha smoothed."""
    # written once: the two totals and the ratios read the counts
    counts = cut_lineage(df.groupBy(token).agg(
        (F.count_if(F.col(label) == 1) + alpha).alias("p"), (F.count_if(F.col(label) == 0) + alpha).alias("q")
    ))
    total_p, total_q = counts.agg(F.sum("p")).scalar(), counts.agg(F.sum("q")).scalar()
    return counts.select(
        token, (F.log(F.col("p") / total_p) - F.log(F.col("q") / total_q)).alias("ratio")
    )


def array_mean(c: Column) -> Column:
    return F.try_divide(F.aggregate(c, F.lit(0.0), lambda acc, x: acc + x), F.size(c))


def array_moments(c: Column) -> dict[str, Column]:
    """Mean, population sd, min, max and median of a numeric array; null when empty."""
    n = F.size(c)
    squares = bound(
        array_mean(c), lambda m: F.aggregate(c, F.lit(0.0), lambda acc, x: acc + (x - m) * (x - m))
    )
    median = bound(
        F.array_sort(c),
        lambda s: (F.get(s, F.floor((F.size(s) - 1) / 2).cast("int")) + F.get(s, F.floor(F.size(s) / 2).cast("int"))) / 2,
    )
    return {
        "mean": array_mean(c),
        "std": F.sqrt(F.try_divide(squares, n)),
        "min": F.array_min(c).cast("double"),
        "max": F.array_max(c).cast("double"),
        "median": F.when(n > 0, median),
    }


def array_shape(c: Column) -> dict[str, Column]:
    """Population skewness and excess kurtosis of a numeric array."""
    def central(acc, x, m):
        d = x - m
        return F.struct(
            (acc["m2"] + d * d).alias("m2"), (acc["m3"] + d * d * d).alias("m3"), (acc["m4"] + d * d * d * d).alias("m4")
        )

    zero = F.struct(*[F.lit(0.0).alias(k) for k in ("m2", "m3", "m4")])
    sums = bound(array_mean(c), lambda m: F.aggregate(c, zero, lambda acc, x: central(acc, x, m)))
    n = F.size(c)
    return {
        "skew": F.try_divide(sums["m3"] / n, F.pow(sums["m2"] / n, F.lit(1.5))),
        "kurtosis": F.try_divide(sums["m4"] / n, F.pow(sums["m2"] / n, F.lit(2.0))) - 3,
    }


def row_total(columns: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(0)) for c in columns])


def row_matches(columns: Sequence[Column], sentinel) -> Column:
    """How many of the columns hold the sentinel (or null, for ``None``)."""
    hit = (lambda c: c.isNull()) if sentinel is None else (lambda c: c == F.lit(sentinel))
    return reduce(lambda a, b: a + b, [F.coalesce(hit(c).cast("int"), F.lit(0)) for c in columns])


def share_of_total(df: DataFrame, column: str) -> DataFrame:
    """Share of each value among all rows."""
    total = df.agg(F.count(F.lit(1))).scalar()
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).withColumn("share", F.col("n") / total)
