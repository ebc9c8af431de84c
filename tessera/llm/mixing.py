"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Each source's documents are permuted by a hash. The words a source gives to
the mix are cut into blocks of equal length along that permutation (a source
that gives more than it has starts its permutation again). The tree then
splits the multiset of blocks: at every node a hash permutes the node's blocks
and the first half goes left, so the number of blocks of each source on the
left is a draw from the multivariate hypergeometric law, and the exact number
of blocks of each source is kept. The leaves are the output shards; inside a
shard a second hash gives the order.

Only DataFrame operations are used. A source's permutation is summed in cells
of the hash's first hex digits, so that no task holds a whole source. The
tables of sources and of blocks are small whatever the corpus: one row per
source, and ``shards * BLOCKS_PER_SHARD`` blocks plus one per source.

Null text has size 0. A null source is a source of its own, the last. Rows of
size 0 are never taken. Repeated rows are separate documents; rows with the
same id share a hash and are ordered by size. An empty table gives no rows.
Columns of the input are kept; ``MIX_COLUMNS`` replace columns of these names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import cut_lineage

SEED = 7
WEIGHTS = (5, 2, 1)
MOST_REPEATS = 3
SHARDS = 16
BLOCKS_PER_SHARD = 64
CELL_DIGITS = 3
WORD = r"[^\x20\x09-\x0D]+"
MIX_COLUMNS = ("size", "source_size", "target", "copies", "taken", "shards")


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def _hash(*parts: Column) -> Column:
    return F.md5(F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts]))


def source_targets(sizes: DataFrame, *, weights=WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """(source, source_size) -> target words: shares by weight, capped, the excess shared anew.

    Sources reach their cap in the order of cap / weight. With the caps of the
    earlier ones set aside, the next is capped if an equal share per weight of
    what is left exceeds its ratio. One row per source, so one small window.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    place = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))
    weight = reduce(lambda rest, i: F.when(place == i, weights[i]).otherwise(rest), range(len(weights)), F.lit(0))
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by_ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    earlier = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    later = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    capped = F.col("ratio") <= F.col("level")
    return (
        sizes.withColumn("weight", weight.cast("long"))
        .withColumn("cap", F.col("source_size") * most)
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(every))
        .withColumn(
            "level",
            (F.col("total") - F.coalesce(F.sum("cap").over(earlier), F.lit(0))) / F.sum("weight").over(later),
        )
        .withColumn("share", F.max(F.when(~capped, F.col("level"))).over(every))
        .select(
            "source", "source_size",
            F.when(capped, F.col("cap").cast("double")).otherwise(F.col("weight") * F.col("share")).alias("target"),
        )
    )


def split_blocks(blocks: DataFrame, shards: int, seed: int = SEED) -> DataFrame:
    """(code, block) -> shard, by halving every node's hashed permutation; ``shards`` is a power of 2."""
    nodes = blocks.withColumn("shard", F.lit(0))
    level = 1
    while level < shards:
        node = Window.partitionBy("shard")
        place = F.row_number().over(node.orderBy(_hash(F.lit(seed), F.lit(level), F.col("code"), F.col("block"))))
        nodes = nodes.withColumn("__place", place).withColumn("__all", F.count(F.lit(1)).over(node)).select(
            "code", "block",
            (F.col("shard") * 2 + (2 * F.col("__place") > F.col("__all") + 1).cast("int")).alias("shard"),
        )
        level *= 2
    return nodes


def mix(docs: DataFrame, *, shards: int = SHARDS, blocks_per_shard: int = BLOCKS_PER_SHARD, seed: int = SEED, ties: list[str] | None = None) -> DataFrame:
    """Every row of ``docs`` with its size, its source's target, how often it is taken and by which shards.

    Columns ``ties`` order rows of one id and size.
    """
    kept = [c for c in docs.columns if c not in MIX_COLUMNS]
    sized = docs.select(
        *kept, word_count().alias("size"), F.substring(_hash(F.lit(seed), F.col("doc_id")), 1, 24).alias("__hash")
    ).withColumn("__cell", F.substring("__hash", 1, CELL_DIGITS))
    cells = cut_lineage(sized.groupBy("source", "__cell").agg(F.sum("size").alias("__words")))
    sizes = cells.groupBy("source").agg(F.sum("__words").alias("source_size"))
    targets = source_targets(sizes).withColumn(
        "code", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    )
    targets = cut_lineage(
        targets.withColumn(
            "length", F.greatest(F.ceil(F.sum("target").over(Window.partitionBy()) / (shards * blocks_per_shard)), F.lit(1))
        )
    )  # one row per source
    # a block more than the quota fills, as the last document may reach beyond it
    blocks = targets.select(
        "code", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("target") / F.col("length")) + 1)).alias("block")
    )
    by_block = split_blocks(blocks, shards, seed).groupBy("code").agg(
        F.map_from_entries(F.collect_list(F.struct("block", "shard"))).alias("shard_of")
    )
    small = cut_lineage(targets.join(by_block, "code").withColumnRenamed("source", "__source"))
    before = Window.partitionBy("source").orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        cells.withColumn("__start", F.coalesce(F.sum("__words").over(before), F.lit(0)))
        .join(small, F.col("source").eqNullSafe(F.col("__source"))).drop("__source", "__words")
        .select(F.col("source").alias("__s"), F.col("__cell").alias("__c"), "__start", "source_size", "target", "code", "length")
    )
    inside = Window.partitionBy("source", "__cell").orderBy("__hash", "size", F.col("doc_id"), *(ties or []))
    running = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = (
        sized.withColumn("__upto", F.sum("size").over(running))
        .join(starts, F.col("source").eqNullSafe(F.col("__s")) & (F.col("__cell") == F.col("__c")))
        .withColumn("__at", F.col("__start") + F.col("__upto") - F.col("size"))
        .withColumn("__full", F.least(F.floor(F.col("target") / F.greatest("source_size", F.lit(1))), F.lit(MOST_REPEATS)))
    )
    # a document is taken once more if more than half of it lies inside the rest of the quota
    rest = F.col("target") - F.col("__full") * F.col("source_size")
    more = ((F.col("__at") + F.col("size") / 2 < rest) & (F.col("__full") < MOST_REPEATS)).cast("long")
    taken = placed.withColumn("copies", F.when(F.col("size") > 0, F.col("__full") + more).otherwise(0).cast("long"))
    turns = F.slice(F.array(*[F.lit(e).cast("long") for e in range(MOST_REPEATS)]), F.lit(1), F.col("copies").cast("int"))
    blocks_of = F.transform(turns, lambda e: F.floor((e * F.col("source_size") + F.col("__at")) / F.col("length")))
    tree = small.select(F.col("code").alias("__code"), "shard_of")
    return (
        taken.withColumn("__blocks", blocks_of)
        .join(tree, F.col("code") == F.col("__code"))
        .select(
            *kept, "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"),
            F.transform("__blocks", lambda b: F.element_at("shard_of", b)).alias("shards"),
        )
    )


def mixed_rows(docs: DataFrame, *, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """The mix itself: the columns of ``docs``, a row per taken copy, dealt to its shard in hashed order."""
    whole = docs.select(
        "doc_id", "source", "text", F.struct(*docs.columns).alias("__row"), F.xxhash64("text").alias("__tie")
    )
    plan = mix(whole, shards=shards, seed=seed, ties=["__tie"])
    each = plan.select("doc_id", "__row", "__tie", F.posexplode("shards").alias("__copy", "__shard"))
    return (
        each.withColumn("__order", _hash(F.lit(seed), F.col("doc_id"), F.col("__copy")))
        .repartition("__shard", F.substring("__order", 1, 1))
        .sortWithinPartitions("__shard", "__order", "__tie")
        .select("__row.*")
    )
