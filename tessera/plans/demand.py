"""Demand: calibrated fallback means and count features."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.scalars import fallback_chain
from tessera.operators.aggregates import group_counts, with_group_counts
from tessera.operators.ranges import dense_codes
from tessera.session import cut_lineage

LEVELS = {"mpca": ["product", "client", "agency"], "mpr": ["product", "route"], "mp": ["product"]}


def fallback_prediction(fit: DataFrame, validate: DataFrame, test: DataFrame) -> DataFrame:
    """Mean log demand of the finest known level, calibrated by a line fitted on ``validate``."""
    fit, validate = (d.withColumn("y", F.log1p("demand")) for d in (fit, validate))
    means = {n: fit.groupBy(*k).agg(F.avg("y").alias(n)) for n, k in LEVELS.items()}

    def with_means(df):
        for name, keys in LEVELS.items():
            df = df.join(means[name], keys, "left")
        return df

    lines = with_means(validate).agg(
        *[f(F.col("y"), F.col(n)).alias(f"{n}_{p}") for n in LEVELS
          for p, f in (("slope", F.regr_slope), ("shift", F.regr_intercept))],
        F.avg("y").alias("level"),
    ).first()
    overall = fit.agg(F.avg("y")).scalar()
    chain = fallback_chain(
        [(F.col(n), F.lit(lines[f"{n}_slope"]), F.lit(lines[f"{n}_shift"])) for n in LEVELS]
        + [(overall, F.lit(1.0), F.lit(lines["level"]))]
    )
    return with_means(test).withColumn("pred", chain)


# The three-way groups counted.
TRIPLES = [
    ("week", "agency", "channel"), ("week", "agency", "route"), ("week", "agency", "client"), ("week", "agency", "product"),
    ("agency", "channel", "route"), ("agency", "channel", "client"), ("agency", "channel", "product"),
    ("channel", "route", "client"), ("channel", "route", "product"),
]


def count_features(df: DataFrame) -> DataFrame:
    """Codes of the six keys with their one-, two- and three-way row counts."""
    keys = ["week", "agency", "channel", "route", "client", "product"]
    df = cut_lineage(df)
    values = group_counts(df, [[k] for k in keys])
    coded = df
    for k in keys:
        # written, so that Spark knows the size of a small table and sends it to every task
        coded = coded.join(cut_lineage(dense_codes(values[(k,)], k, f"{k}_id")), k, "left")
    groups = [(k,) for k in keys] + list(combinations(keys, 2)) + TRIPLES
    counts = {"_".join(g) + "_cnt": list(g) for g in groups}
    ids = [f"{k}_id" for k in keys]
    out = with_group_counts(cut_lineage(coded), counts, values)
    # rows without one of the keys count, but have no code
    kept = out.where(reduce(lambda x, y: x & y, [F.col(c).isNotNull() for c in ids]))
    return kept.select(*reversed(keys), *[c for c in df.columns if c not in keys], *counts, *ids)
