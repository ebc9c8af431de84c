"""Claim rows: rebuilt integers, interactions, indicators, combined category codes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.scalars import square_code
from tessera.operators.aggregates import row_matches
from tessera.operators.fills import above_centre
from tessera.operators.frames import indicator_code
from tessera.operators.ranges import dense_codes


def combined_code(df: DataFrame, a: str, b: str) -> DataFrame:
    """Code (from 0) of the joined text of two categories, fitted on all rows given."""
    name = f"{a}_plus_{b}"
    keyed = df.withColumn("__k", F.concat_ws("_", F.col(a).cast("string"), F.col(b).cast("string")))
    codes = dense_codes(keyed, "__k", name, start=0)
    return keyed.join(codes, "__k").drop("__k")


def claim_features(
    df: DataFrame, numeric: Sequence[str], flags: Sequence[str], combos: Sequence[tuple[str, str]],
    reg: str, size: str, sentinel: float = -1.0,
) -> DataFrame:
    """All claim features; ``flags`` are mutually exclusive 0/1 columns folded into one code."""
    a, m = square_code(F.col(reg))
    out = df.select(
        "*", a.alias("reg_a"), m.alias("reg_m"), (F.col(size) * F.col(reg)).alias(f"{size}_x_{reg}"),
        F.pow(size, F.lit(2.0)).alias(f"{size}_sq"),
        row_matches([F.col(c) for c in numeric], sentinel).alias("negative_one_vals"),
        indicator_code([F.col(c) for c in flags]).alias("flag_code"), *above_centre(df, numeric),
    )
    for one, two in combos:
        out = combined_code(out, one, two)
    return out
