"""Set-similarity join: all pairs of sets above a Jaccard share, found by length and prefix.

Items are ordered by how many sets hold them, rarest first. Two sets of n and m
items that share ``percent`` of their union have sizes within that share of each
other and hold a common item among their first n - ceil(share * n) + 1 items, so
only sets that meet in such an item are compared. The filters lose no pair.
Equal sets are joined once, as one set with many owners.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.session import cut_lineage, shuffles_for


def ordered_sets(sets: DataFrame, counts: DataFrame) -> DataFrame:
    """(id, item) -> (id, items), distinct items rarest first. A row holds one set."""
    ranked = F.sort_array(F.collect_list(F.struct("__c", "item")))
    return sets.select("id", "item").distinct().join(counts, "item").groupBy("id").agg(ranked.alias("items")).select(
        "id", F.transform("items", lambda i: i["item"]).alias("items")
    )


def _prefix(sets: DataFrame, percent: int) -> DataFrame:
    n = F.size("items")
    least = F.floor((n * percent + 99) / 100).cast("int")
    return sets.select("rep", n.alias("n"), F.posexplode(F.slice("items", F.lit(1), n - least + 1)).alias("at", "item"))


def similar_sets(left: DataFrame, right: DataFrame, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Two tables (id, item) -> pairs of distinct sets, and who owns them.

    Gives (rep, rep2, n, n2, common) of all pairs with 100 * common >= percent * union, and
    (id, rep) of either side; ``rep`` is the first owner of a set. Sets without items pair with none.
    """
    held = left.select("id", "item").distinct().unionAll(right.select("id", "item").distinct())
    spark, rows = left.sparkSession, left.count() + right.count()
    with shuffles_for(spark, rows):
        counts = cut_lineage(held.groupBy("item").agg(F.count(F.lit(1)).alias("__c")))
    # an item held c times brings c * c / 4 pairs of left and right together at most
    meetings = int(counts.agg(F.sum(F.col("__c") * F.col("__c").cast("double"))).first()[0] or 0) // 4
    sides = []
    for sets in (left, right):
        with shuffles_for(spark, rows):
            owned = cut_lineage(ordered_sets(sets.where(F.col("item").isNotNull()), counts))
            reps = cut_lineage(owned.groupBy("items").agg(F.min("id").alias("rep")))
            sides.append((reps, cut_lineage(owned.join(reps, "items").select("id", "rep"))))
    (a, owners), (b, owners2) = sides
    one = _prefix(a, percent)
    two = _prefix(b, percent).select("item", F.col("rep").alias("rep2"), F.col("n").alias("n2"), F.col("at").alias("at2"))
    sizes = F.least("n", "n2") * 100 >= F.greatest("n", "n2") * percent
    # what the two can share at most: the items before both places, this one, and those after it
    most = F.least("at", "at2") + 1 + F.least(F.col("n") - F.col("at"), F.col("n2") - F.col("at2")) - 1
    enough = most * (100 + percent) >= (F.col("n") + F.col("n2")) * percent
    met = one.join(two, "item").where(sizes & enough).select("rep", "rep2").distinct()
    common = F.size(F.array_intersect("items", "items2"))
    n, n2 = F.size("items"), F.size("items2")
    pairs = (
        met.join(a, "rep").join(b.select(F.col("rep").alias("rep2"), F.col("items").alias("items2")), "rep2")
        .select("rep", "rep2", n.alias("n"), n2.alias("n2"), common.alias("common"))
        .where(F.col("common") * (100 + percent) >= (F.col("n") + F.col("n2")) * percent)
    )
    with shuffles_for(spark, max(rows, meetings)):
        return cut_lineage(pairs), owners, owners2


def jaccard_of() -> Column:
    return F.col("common") / (F.col("n") + F.col("n2") - F.col("common"))


def dice_of() -> Column:
    return 2 * F.col("common") / (F.col("n") + F.col("n2"))


def set_pairs(left: DataFrame, right: DataFrame, percent: int) -> DataFrame:
    """(id, id2, jaccard, dice) for every owner on either side."""
    pairs, owners, owners2 = similar_sets(left, right, percent)
    return (
        pairs.join(owners, "rep").join(owners2.select(F.col("id").alias("id2"), F.col("rep").alias("rep2")), "rep2")
        .select("id", "id2", jaccard_of().alias("jaccard"), dice_of().alias("dice"))
    )


def class_distances(left: DataFrame, right: DataFrame, classes: DataFrame, percent: int, quantiles=(0.0, 0.5, 1.0)) -> DataFrame:
    """Per (id, class) over all similar sets of the other side: rows, mean, std and quantiles of their Jaccard share.

    ``classes`` is (id, class) of the right side. Equal sets count as often as they have
    owners of the class, without being listed; a share is a ratio of two set sizes, so a group
    holds few different values however many rows it stands for.
    """
    pairs, owners, owners2 = similar_sets(left, right, percent)
    owned = owners2.join(classes, "id").groupBy(F.col("rep").alias("rep2"), "class").agg(F.count(F.lit(1)).alias("w"))
    j, w = F.col("j"), F.col("w")
    shares = pairs.select("rep", "rep2", jaccard_of().alias("j")).join(owned, "rep2").groupBy("rep", "class", "j").agg(F.sum("w").alias("w"))
    mean = F.sum(j * w) / F.sum("w")
    spread = F.sqrt(F.greatest(F.sum(j * j * w) / F.sum("w") - mean * mean, F.lit(0.0)))
    stats = shares.groupBy("rep", "class").agg(
        F.sum("w").alias("rows"), mean.alias("mean"), spread.alias("std"),
        *[F.percentile("j", q, F.col("w")).alias(f"q{round(q * 100)}") for q in quantiles],
    )
    return stats.join(owners, "rep").drop("rep")
