"""Ranks, running sums and quantiles that never put one key's rows into one task.

A plain window sends every row of a key to a single task. Here the key is cut
into ordered ranges; each range is windowed alone and then shifted by what the
earlier ranges of the key hold. The table of ranges has at most ``parts`` rows
per key, so the window over it is small whatever the key's size.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import cut_lineage

_OVERSAMPLE = 16
_RANGE = "__range"
# rows of a key that one task may sort; the rows of a larger key are cut into ranges
LARGE = 1 << 20


def default_parts(df: DataFrame) -> int:
    """As many ranges as shuffle partitions, 32 at least."""
    return max(32, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def split_points(df: DataFrame, order: Sequence[str], parts: int | None = None) -> list[tuple]:
    """Ordered cut points for ``order``, whole values from a sample of about ``parts * 16`` rows.

    The points only balance the ranges; any choice gives the same results. Rows are drawn by a
    hash under a share of the counted rows, so what reaches the driver depends on ``parts`` alone,
    not on the rows or their partitions.
    """
    parts = parts or default_parts(df)
    keys = df.select(*order)
    share = parts * _OVERSAMPLE / max(keys.count(), 1)
    drawn = F.pmod(F.xxhash64(*order, F.monotonically_increasing_id()), F.lit(1 << 40)) < int(min(share, 1.0) * (1 << 40))
    sample = keys.where(drawn).collect()
    # NULL and NaN have their place at the ends of the order and are no cut points
    values = sorted({tuple(row) for row in sample if all(v is not None and v == v for v in row)})
    if len(values) <= parts:
        return values[1:]
    step = len(values) / parts
    return sorted({values[int(i * step)] for i in range(1, parts)})


def range_bucket(df: DataFrame, order: Sequence[str], parts: int | None = None) -> Column:
    """Range number of a row: how many cut points are not above its key.

    Keys are compared as structs, whose order is that of a sort: NULL first,
    NaN last. A coarse and a fine search read two roots of the number of points.
    """
    points = split_points(df, order, parts)
    if not points:
        return F.lit(0)
    types = [df.schema[c].dataType for c in order]
    # names of their own, so that a literal and a key have one type
    key = F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(order)])
    cells = [F.struct(*[F.lit(v).cast(t).alias(f"k{i}") for i, (v, t) in enumerate(zip(p, types))]) for p in points]
    width = math.isqrt(len(cells) - 1) + 1
    every, coarse = F.array(*cells), F.array(*cells[::width])
    blocks = F.size(F.filter(coarse, lambda p: p <= key))
    fine = F.slice(every, (blocks - 1) * width + 1, F.lit(width))
    return F.when(blocks == 0, 0).otherwise((blocks - 1) * width + F.size(F.filter(fine, lambda p: p <= key)))


def split_window(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    *,
    bucket: Column | None = None,
    row_number: str | None = None,
    lags: Mapping[str, str] | None = None,
    sums: Mapping[str, str] | None = None,
    parts: int | None = None,
) -> DataFrame:
    """Row number, previous value and running sum per key in ascending ``order``.

    Keys of up to ``LARGE`` rows are windowed whole, after one count of the
    rows per key. For larger keys, and without keys, cut points are sampled
    over the rows, so that with a unique ``order`` a range holds about 1/parts
    of them and no cell of (key, range) more, even if one key has most rows.
    ``bucket`` replaces them by any expression
    that never decreases along ``order`` and is not null; then no job runs
    before the result is asked for. The rows are shuffled once, by cell; a
    cell's last row carries its totals to the table of cells. ``lags`` and
    ``sums`` map an output column to its input column.
    """
    lags, sums = dict(lags or {}), dict(sums or {})
    keys, order = list(keys), list(order)
    if keys and bucket is None:
        whole = Window.partitionBy(*keys).orderBy(*order)
        running = whole.rowsBetween(Window.unboundedPreceding, Window.currentRow)

        def plain(rows: DataFrame) -> DataFrame:
            return rows.select(
                *df.columns,
                *([F.row_number().over(whole).cast("long").alias(row_number)] if row_number else []),
                *[F.lag(c).over(whole).alias(o) for o, c in lags.items()],
                *[F.sum(c).over(running).alias(o) for o, c in sums.items()],
            )

        sizes = df.groupBy(*[F.col(c).alias(f"__k_{c}") for c in keys]).agg(F.count(F.lit(1)).alias("__n"))
        large = cut_lineage(sizes.where(F.col("__n") > LARGE).drop("__n"))
        if large.isEmpty():
            return plain(df)
        held = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__k_{c}")) for c in keys])
        # at most one key for LARGE rows, so the planner sends them to every task
        rest, df = df.join(large, held, "left_anti"), cut_lineage(df.join(large, held, "left_semi"))
        cut = split_window(
            df, keys, order, bucket=range_bucket(df, order, parts), row_number=row_number, lags=lags, sums=sums, parts=parts,
        )
        return plain(rest).unionByName(cut)
    group = [*keys, _RANGE]
    work = df.withColumn(_RANGE, bucket if bucket is not None else range_bucket(df, order, parts))
    local = Window.partitionBy(*group).orderBy(*order)
    upto = local.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    work = work.select(
        "*",
        F.row_number().over(local).alias("__rn"),
        F.lead(F.lit(False), 1, True).over(local).alias("__end"),
        *[F.lag(c).over(local).alias(f"__lag_{o}") for o, c in lags.items()],
        *[F.sum(c).over(upto).alias(f"__run_{o}") for o, c in sums.items()],
    )
    # same shuffle as the rows themselves; one row per cell
    cells = work.where("__end").select(
        *[F.col(c).alias(f"__k_{c}") for c in group], "__rn",
        *[F.col(f"__run_{o}").alias(f"__sum_{o}") for o in sums],
        *[F.struct(F.col(c).alias("v")).alias(f"__last_{o}") for o, c in lags.items()],
    )
    earlier = (
        Window.partitionBy(*[f"__k_{c}" for c in keys]).orderBy(f"__k_{_RANGE}").rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = cells.select(
        *[f"__k_{c}" for c in group],
        F.coalesce(F.sum("__rn").over(earlier), F.lit(0)).alias("__before"),
        *[F.sum(f"__sum_{o}").over(earlier).alias(f"__before_{o}") for o in sums],
        *[F.last(f"__last_{o}").over(earlier)["v"].alias(f"__carry_{o}") for o in lags],
    )
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__k_{c}")) for c in group])
    out = [F.col(c) for c in df.columns]
    if row_number:
        out.append((F.col("__before") + F.col("__rn")).cast("long").alias(row_number))
    for o in lags:
        out.append(
            F.when(F.col("__rn") == 1, F.col(f"__carry_{o}")).otherwise(F.col(f"__lag_{o}")).alias(o)
        )
    for o in sums:
        run, before = F.col(f"__run_{o}"), F.col(f"__before_{o}")
        out.append(F.when(run.isNull(), before).otherwise(run + F.coalesce(before, F.lit(0))).alias(o))
    return work.join(offsets, same, "inner").select(*out)


def group_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, quantiles: Mapping[str, float]
) -> DataFrame:
    """Exact interpolated quantiles per key; a key may hold any number of values."""
    keys = list(keys)
    counts = (
        df.where(F.col(value).isNotNull())
        .groupBy(*keys, F.col(value).alias("__v"))
        .agg(F.count(F.lit(1)).alias("__c"))
    )
    ranked = split_window(counts, keys, ["__v"], sums={"__cum": "__c"})
    totals = counts.groupBy(*keys).agg(F.sum("__c").alias("__t"))
    ranked = ranked.join(totals, keys) if keys else ranked.withColumn("__t", totals.scalar())
    aggs = []
    for name, q in quantiles.items():
        at = (F.col("__t") - 1) * F.lit(float(q))
        low, high = F.floor(at), F.ceil(at)

        def picked(pos):
            hit = (F.col("__cum") > pos) & (F.col("__cum") - F.col("__c") <= pos)
            return F.max(F.when(hit, F.col("__v")))

        frac = F.max(at - low)
        aggs.append((picked(low) + (picked(high) - picked(low)) * frac).alias(name))
    return ranked.groupBy(*keys).agg(*aggs)


def dense_codes(df: DataFrame, column: str, out: str, start: int = 1) -> DataFrame:
    """Code table: each distinct value with its position in ascending order."""
    values = df.select(column).where(F.col(column).isNotNull()).distinct()
    ranked = split_window(values, [], [column], row_number=out)
    return ranked.withColumn(out, F.col(out) + (start - 1)) if start != 1 else ranked


def average_rank(df: DataFrame, column: str, out: str) -> DataFrame:
    """Rank table: each distinct value with its 1-based rank, ties averaged, and its count."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("ties"))
    ranked = split_window(counts, [], [column], sums={"__cum": "ties"})
    return ranked.select(column, "ties", (F.col("__cum") - (F.col("ties") - 1) / 2).alias(out))


def number_chunks(
    df: DataFrame, keys: Sequence[str], value: str, size: int = 10_000
) -> DataFrame:
    """Values per key as ordered lists of at most ``size`` items: (keys, chunk, items)."""
    ranked = split_window(df.select(*keys, value), keys, [value], row_number="__pos")
    return (
        ranked.withColumn("chunk", F.floor((F.col("__pos") - 1) / size).cast("long"))
        .groupBy(*keys, "chunk")
        .agg(F.sort_array(F.collect_list(value)).alias("items"))
    )
