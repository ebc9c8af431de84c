"""Evaluation metrics. Orderings are cut into ranges, so no metric needs one sorted task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.ranges import average_rank, dense_codes, range_bucket, split_window


def regression_metrics(y: str, p: str) -> dict[str, Column]:
    """Aggregate expressions: mse, rmse, mae, r2 and rmsle."""
    err = F.col(y) - F.col(p)
    mse = F.avg(err * err)
    return {
        "mse": mse,
        "rmse": F.sqrt(mse),
        "mae": F.avg(F.abs(err)),
        "r2": 1 - F.try_divide(mse, F.var_pop(y)),
        "rmsle": F.sqrt(F.avg(F.pow(F.log1p(y) - F.log1p(p), F.lit(2.0)))),
    }


def logloss(y: str, p: str, eps: float = 1e-15) -> Column:
    q = F.least(F.greatest(F.col(p), F.lit(eps)), F.lit(1 - eps))
    return F.avg(F.when(F.col(y) == 1, -F.log(q)).otherwise(-F.log(1 - q)))


def ordered_cells(df: DataFrame, order: Sequence[str], value: str, weight: Column) -> DataFrame:
    """One row per range of the ``order``: rows ``n``, sums ``total`` and ``weight``, and ``gained``.

    ``gained`` sums, over the range's rows, the weight times the running sum of ``value`` over all rows
    up to that one. Each range is sorted once and only its sums are joined with those of earlier ranges.
    """
    rows = df.select(range_bucket(df, order).alias("__range"), *order, F.col(value).alias("__v"), weight.alias("__w"))
    upto = Window.partitionBy("__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cells = rows.withColumn("__run", F.sum("__v").over(upto)).groupBy("__range").agg(
        F.count(F.lit(1)).alias("n"), F.sum("__v").alias("total"), F.sum("__w").alias("weight"),
        F.coalesce(F.sum(F.col("__w") * F.col("__run")), F.lit(0)).alias("__own"),
    )
    earlier = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    above = F.coalesce(F.sum("total").over(earlier), F.lit(0))
    return cells.select("n", "total", "weight", (F.col("__own") + above * F.coalesce("weight", F.lit(0))).alias("gained"))


def gini(df: DataFrame, y: str, p: str, key: str) -> DataFrame:
    """Normalised Gini: cumulative gain by falling prediction over that by falling target.

    Ties are ordered by ``key``. One row: gini, gini_perfect, gini_normalised.
    """
    values = df.select(F.col(key).alias("__id"), F.col(y).cast("double").alias("__y"), (-F.col(p)).alias("__p"))
    # rows of equal target may stand in any order: each distinct target is one row of the perfect order
    targets = df.groupBy((-F.col(y)).cast("double").alias("__t")).agg(F.count(F.lit(1)).alias("__n"), F.sum(F.col(y).cast("double")).alias("__s"))
    perfect = split_window(targets, [], ["__t"], sums={"__cum": "__s"})
    rows, total = F.col("__n"), F.col("__s")

    def normal(gained, n, whole):
        return (gained / whole - (n + 1) / 2) / n

    # a target's rows stand on what came before them, and each on the rows of its target up to it
    held = F.coalesce("__cum", F.lit(0.0)) - F.coalesce(total, F.lit(0.0))
    best = perfect.agg(normal(F.sum(rows * held + F.coalesce(total, F.lit(0.0)) * (rows + 1) / 2), F.sum(rows), F.sum(total))).scalar()
    cells = ordered_cells(values, ["__p", "__id"], "__y", F.lit(1))
    got = cells.agg(normal(F.sum("gained"), F.sum("n"), F.sum("total"))).scalar()
    one = df.agg(F.count(F.lit(1)).alias("n"))
    return one.select(got.alias("gini"), best.alias("gini_perfect")).withColumn(
        "gini_normalised", F.col("gini") / F.col("gini_perfect")
    )


def roc_auc(df: DataFrame, y: str, p: str) -> DataFrame:
    """Area under the ROC curve by the rank sum, ties at their mean rank."""
    cells = df.groupBy(p).agg(F.count(F.lit(1)).alias("n"), F.sum(y).alias("pos"))
    run = split_window(cells, [], [p], sums={"cum": "n"})
    rank = F.col("cum") - (F.col("n") - 1) / 2
    pos, total = F.sum("pos"), F.sum("n")
    return run.agg(
        ((F.sum(rank * F.col("pos")) - pos * (pos + 1) / 2) / (pos * (total - pos))).alias("auc")
    )


def f_beta_per_group(df: DataFrame, group: str, y: str, p: str, thresholds: Sequence[float], beta: float = 1.0) -> DataFrame:
    """Mean over groups of F-beta at each threshold; an empty group pair scores 1."""
    b2 = beta * beta
    counts = []
    for i, cut in enumerate(thresholds):
        hit = F.col(p) > cut
        counts += [
            F.count_if(hit & (F.col(y) == 1)).alias(f"tp{i}"),
            F.count_if(hit & (F.col(y) == 0)).alias(f"fp{i}"),
            F.count_if(~hit & (F.col(y) == 1)).alias(f"fn{i}"),
        ]
    per = df.groupBy(group).agg(*counts)

    def score(i):
        tp, fp, fn = (F.col(f"{k}{i}") for k in ("tp", "fp", "fn"))
        base = (1 + b2) * tp + fp + b2 * fn
        return F.when(base == 0, F.lit(1.0)).otherwise((1 + b2) * tp / base)

    wide = per.agg(*[F.avg(score(i)).alias(f"f{i}") for i in range(len(thresholds))])
    pairs = F.array(*[F.struct(F.lit(float(c)).alias("threshold"), F.col(f"f{i}").alias("score")) for i, c in enumerate(thresholds)])
    return wide.select(F.inline(pairs))


def accuracy(y: str, p: str) -> Column:
    return F.avg((F.col(y) == F.col(p)).cast("double"))


def pearson(df: DataFrame, a: str, b: str) -> Column:
    return df.agg(F.corr(a, b)).scalar()


def spearman(df: DataFrame, a: str, b: str) -> Column:
    """Correlation of tie-averaged ranks."""
    ranks_a = average_rank(df, a, "__ra").drop("ties")
    ranks_b = average_rank(df, b, "__rb").drop("ties")
    cells = df.groupBy(a, b).agg(F.count(F.lit(1)).alias("__w")).join(ranks_a, a).join(ranks_b, b)
    x, y, w = F.col("__ra"), F.col("__rb"), F.col("__w")
    n = F.sum(w)
    cov = F.sum(w * x * y) / n - F.sum(w * x) * F.sum(w * y) / (n * n)
    var_x = F.sum(w * x * x) / n - F.pow(F.sum(w * x) / n, F.lit(2.0))
    var_y = F.sum(w * y * y) / n - F.pow(F.sum(w * y) / n, F.lit(2.0))
    return cells.agg(cov / F.sqrt(var_x * var_y)).scalar()


def kolmogorov_smirnov(df: DataFrame, a: str, b: str) -> Column:
    """Largest gap between the distribution functions of two columns."""
    stacked = df.select(F.explode(F.array(
        F.struct(F.col(a).cast("double").alias("v"), F.lit(1).alias("x"), F.lit(0).alias("y")),
        F.struct(F.col(b).cast("double").alias("v"), F.lit(0).alias("x"), F.lit(1).alias("y")),
    )).alias("s")).select("s.*").groupBy("v").agg(F.sum("x").alias("x"), F.sum("y").alias("y"))
    run = split_window(stacked, [], ["v"], sums={"cx": "x", "cy": "y"})
    return run.agg(F.max(F.abs(F.col("cx") - F.col("cy")))).scalar() / df.agg(F.count(F.lit(1))).scalar()


def kendall_tau_b(df: DataFrame, a: str, b: str) -> Column:
    """Kendall's tau-b without pairing rows.

    Rows are first merged into weighted (a, b) cells and ``b`` coded 0, 1, 2, ...
    Going through the cells in order of (a, b), a cell is discordant with each
    earlier one of greater code. Two codes differ first at one bit, so per bit
    and shared prefix it is enough to sum, before each 0, the weight of 1s seen.
    """
    cells = df.groupBy(a, b).agg(F.count(F.lit(1)).alias("w"))
    codes = dense_codes(cells, b, "code", start=0)
    coded = cells.join(codes, b)
    top = coded.agg(F.max("code")).scalar()
    levels = F.sequence(F.lit(0), F.length(F.bin(top)) - 1)
    spread = coded.select(a, b, "w", "code", F.explode(levels).alias("level"))
    bit = F.expr("shiftright(code, level) & 1")
    spread = spread.select(
        a, b, "w", "level", F.expr("shiftright(code, level + 1)").alias("prefix"), bit.alias("bit"),
        (F.col("w") * bit).alias("ones"),
    )
    run = split_window(spread, ["level", "prefix"], [a, b], sums={"seen": "ones"})
    # codes equal in a never count: within one value of a, b ascends
    discordant = run.agg(F.sum(F.when(F.col("bit") == 0, F.col("w") * F.col("seen")).otherwise(0))).scalar()

    def ties(*cols):
        g = cells.groupBy(*cols).agg(F.sum("w").alias("t")) if cols else cells.agg(F.sum("w").alias("t"))
        return g.agg(F.sum(F.col("t") * (F.col("t") - 1) / 2)).scalar()

    n0, n1, n2, n3 = ties(), ties(a), ties(b), ties(a, b)
    return (n0 - n1 - n2 + n3 - 2 * discordant) / F.sqrt((n0 - n1) * (n0 - n2))


def gini_pairwise(df: DataFrame, y: str, p: str, key: str) -> DataFrame:
    """1 - 2 x (share of wrongly ordered 1/0 pairs), from the zeros ranked above each one."""
    base = df.select(F.col(key).alias("__id"), F.col(y).alias("__y"), (1 - F.col(y)).alias("__z"), (-F.col(p)).alias("__p"))
    cells = ordered_cells(base, ["__p", "__id"], "__z", F.col("__y"))
    ones, n = F.sum("weight"), F.sum("n")
    return cells.agg((1 - 2 * F.sum("gained") / (ones * (n - ones))).alias("gini"))
