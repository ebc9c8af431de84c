"""Splits, folds and resampling, all fixed by a hash of the row key."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.encoders import hash_bucket
from tessera.operators.ranges import split_window


def hold_out(df: DataFrame, key: Column, percent: int) -> tuple[DataFrame, DataFrame]:
    """(train, valid): rows whose key hashes under ``percent`` of 100 are held out, whole groups together."""
    held = hash_bucket(key, 100) < percent
    return df.where(~held), df.where(held)


def hold_out_times(df: DataFrame, time: str, times: Sequence) -> DataFrame:
    """Each row once per left-out time, tagged: ``valid`` when the row is of that time."""
    return df.withColumn("left_out", F.explode(F.array(*[F.lit(x) for x in times]))).withColumn(
        "part", F.when(F.col(time) == F.col("left_out"), "valid").otherwise("train")
    )


def folds(df: DataFrame, key: Column, k: int, out: str = "fold") -> DataFrame:
    return df.withColumn(out, hash_bucket(key, k))


def stratified_folds(df: DataFrame, key: str, label: str, k: int, out: str = "fold") -> DataFrame:
    """Folds whose class counts differ by at most one: rank by hash within the class, modulo k."""
    hashed = df.withColumn("__h", hash_bucket(F.col(key), 1 << 60))
    return split_window(hashed, [label], ["__h", key], row_number="__r").withColumn(out, (F.col("__r") - 1) % k).drop("__h", "__r")


def oversample(df: DataFrame, key: str, label: str, target: float) -> DataFrame:
    """Repeat class 0 until class 1 is ``target`` of the rows: doublings, then a part more.

    With s = share / target - 1, class 0 doubles while s > 1 (s falls by one each
    time) and then its first s parts, by copy and key, are added again.
    """
    share = df.agg(F.avg(label)).first()[0]
    scale = share / target - 1
    copies = 1
    while scale > 1:
        copies, scale = copies * 2, scale - 1
    zero = df.where(F.col(label) == 0).withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(copies))))
    ranked = split_window(zero, [], ["copy", key], row_number="__r")
    extra = math.floor(max(scale, 0.0) * zero.count())
    more = ranked.where(F.col("__r") <= extra).withColumn("copy", F.col("copy") + copies)
    return df.where(F.col(label) == 1).withColumn("copy", F.lit(1)).unionByName(ranked.drop("__r")).unionByName(more.drop("__r"))


def up_down_sample(df: DataFrame, key: str, label: str, keep: float = 0.8) -> DataFrame:
    """Class 0 twice and the first ``keep`` of class 1 by key."""
    zero = df.where(F.col(label) == 0).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    ones = split_window(df.where(F.col(label) == 1), [], [key], row_number="__r")
    limit = F.floor(df.where(F.col(label) == 1).agg(F.count(F.lit(1))).scalar() * keep)
    return zero.unionByName(ones.where(F.col("__r") <= limit).drop("__r").withColumn("copy", F.lit(1)))


def bootstrap(groups: DataFrame, key: str, draws: int) -> DataFrame:
    """(draw, slot, key): as many keys as there are, with replacement, per draw."""
    numbered = split_window(groups.select(key).distinct(), [], [key], row_number="slot")
    n = numbered.agg(F.count(F.lit(1))).scalar()
    slots = numbered.select("slot", F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("draw"))
    picks = slots.withColumn("__at", hash_bucket(F.concat_ws("-", "draw", "slot"), n) + 1)
    return picks.join(numbered.select(F.col("slot").alias("__at"), key), "__at").select("draw", "slot", key)


POISSON_BITS = 32


def poisson_cuts(bits: int = POISSON_BITS) -> list[int]:
    """A uniform number of ``bits`` bits stands for k when it has reached the first k of these (mean 1)."""
    cuts, term, total = [], math.exp(-1), math.exp(-1)
    for k in range(1, 16):
        cuts.append(math.floor(total * (1 << bits)))
        term /= k
        total += term
    return [c for c in cuts if c < 1 << bits]


def poisson_means(df: DataFrame, key: Column, value: str, draws: int, groups: Sequence[str] = ()) -> DataFrame:
    """(groups, draw, rows, mean): the mean of ``value`` in each of ``draws`` resamples of the rows.

    A row is taken a Poisson(1) number of times, which for many rows is a draw with replacement. The
    number is a hash of (draw, key), so all draws are sums in one aggregation with partial
    sums before the shuffle, and reruns agree.
    """
    times = sum((F.col("__u") >= c).cast("int") for c in poisson_cuts())
    drawn = df.select(*groups, value, key.alias("__key"), F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("draw"))
    counted = drawn.withColumn("__u", hash_bucket(F.concat_ws("-", "draw", "__key"), 1 << POISSON_BITS)).select(
        *groups, "draw", value, times.cast("long").alias("__t")
    )
    return counted.groupBy(*groups, "draw").agg(
        F.sum("__t").alias("rows"), (F.sum(F.col(value) * F.col("__t")) / F.sum(F.when(F.col(value).isNotNull(), F.col("__t")))).alias("mean")
    )


def equal_bags(df: DataFrame, bag: str, instance: str, size: int) -> DataFrame:
    """``size`` instances per bag: in hash order, from the start again when a bag is smaller."""
    hashed = df.withColumn("__h", hash_bucket(F.concat_ws("-", bag, instance), 1 << 60))
    ranked = split_window(hashed, [bag], ["__h", instance], row_number="__r")
    sizes = df.groupBy(bag).agg(F.count(F.lit(1)).alias("__n"))
    slots = F.when(F.col("__r") <= size, F.sequence(F.col("__r"), F.lit(size).cast("long"), F.col("__n"))).otherwise(F.array().cast("array<bigint>"))
    return ranked.join(sizes, bag).withColumn("slot", F.explode(slots)).drop("__h", "__r", "__n")


def with_noise(df: DataFrame, key: Column, column: str, level: float, seed: int) -> DataFrame:
    """Multiply by 1 + level x standard normal noise, drawn from two hashes of ``key``: reruns agree."""
    def uniform(draw: int) -> Column:
        return (hash_bucket(F.concat_ws("-", F.lit(seed), F.lit(draw), key), 1 << 60) + 0.5) / float(1 << 60)

    normal = F.sqrt(-2 * F.log(uniform(1))) * F.cos(2 * math.pi * uniform(2))
    return df.withColumn(column, F.col(column) * (1 + level * normal))
