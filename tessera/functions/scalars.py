"""Numeric, conditional and date expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def safe_ratio(x, y) -> Column:
    """x / y, 0 where y is 0."""
    return F.coalesce(F.try_divide(x, y), F.lit(0.0))


def fallback_chain(levels: Sequence[tuple[Column, float, float]]) -> Column:
    """First known log-mean of the levels, back on the raw scale: expm1(a) * scale + shift."""
    return F.coalesce(*[F.expm1(a) * scale + shift for a, scale, shift in levels])


def clip(x, low, high) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def clip_scale(x: Column, low: float, high: float, missing: float, digits: int = 4) -> Column:
    """Clip to [low, high] and scale to [0, 1]; null takes ``missing`` before scaling."""
    return F.round((clip(F.coalesce(x, F.lit(missing)), low, high) - low) / (high - low), digits)


def range_code(x: Column, ranges: Sequence[tuple[float, float]], other: int) -> Column:
    """Index of the closed range that holds x; values between ranges take ``other``."""
    out = None
    for i, (low, high) in enumerate(ranges):
        hit = x.between(low, high)
        out = F.when(hit, i) if out is None else out.when(hit, i)
    return out.otherwise(other)


# Closed ranges of the group codes.
SENIORITY_RANGES = [(0, 50), (51, 100), (101, 150), (151, 200), (202, 256)]
AGE_RANGES = [(0, 19), (20, 40), (41, 55), (56, 100)]
INCOME_RANGES = [(0, 60000), (60001, 120000), (120001, 1500000)]

# Codes of sex x activity and of new customer x segment.
SEX_ACTIVITY = {"H1": 0, "H0": 1, "HN": 2, "V1": 3, "V0": 4, "VN": 5, "N1": 6, "N0": 7, "NN": 8}
NEW_SEGMENT = {0: 0, 1: 1, 10: 2, 11: 3, 12: 4, 20: 5, 21: 6, 30: 7, 31: 8}


def seniority_group(x: Column) -> Column:
    return range_code(clip(F.coalesce(x, F.lit(0.0)), 0.0, 256.0), SENIORITY_RANGES, 5)


def age_group(x: Column) -> Column:
    return range_code(clip(F.coalesce(x, F.lit(40.0)), 0.0, 100.0), AGE_RANGES, 4)


def income_group(x: Column) -> Column:
    return range_code(clip(x, 0.0, 1500000.0), INCOME_RANGES, 3)


def pair_code(key: Column, codes: Mapping) -> Column:
    table = F.create_map(*[F.lit(v) for pair in codes.items() for v in pair])
    return table[key]


def marriage_index(age: Column, sex: Column, income: Column) -> Column:
    """1 above the usual marriage age: 28, less 2 for sex V, less 1 up to income 101850."""
    limit = 28 - F.when(sex == "V", 2).otherwise(0) - F.when(income <= 101850, 1).otherwise(0)
    return F.when(age <= limit, 0).otherwise(1)


def square_code(reg: Column, sentinel_a: int = 19, sentinel_m: int = 51) -> tuple[Column, Column]:
    """Integer parts behind a rounded square root: n = round((40 r)^2), A + 31 M = n, A in 1..31."""
    n = F.round(F.pow(reg * 40, F.lit(2.0))).cast("long")
    a = F.when(n % 31 == 0, 31).otherwise(n % 31)
    m = F.floor((n - a) / 31)
    blank = lambda c, s: F.when(c == s, -1).otherwise(c).cast("long")
    return blank(a, sentinel_a), blank(m, sentinel_m)


def prior_correction(x, g0, g1) -> Column:
    """Shift a probability to another class balance."""
    return g1 * x / (g1 * x + g0 * (1 - x))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def bounded_logloss(y: Column, p: Column, eps: float = 1e-15) -> Column:
    q = clip(p, eps, 1 - eps)
    return F.when(y == 1, -F.log(q)).otherwise(-F.log(1 - q))


def month_or_hash(text: Column, key: Column) -> Column:
    """Month of a yyyy-MM-dd text; a missing date takes a month fixed by the key."""
    blank = text.isNull() | F.trim(text).isin("", "NA")
    return F.when(blank, F.pmod(F.crc32(key.cast("string")), F.lit(12)) + 1).otherwise(
        F.split(text, "-")[1].cast("long")
    )


# Words for the sign and size of a polarity score.
SIGN_WORDS = {-1: "negative", 0: "neutral", 1: "positive"}
SIZE_WORDS = {0: "zero", 1: "one", 2: "two", 3: "three", 4: "four", 5: "five", 6: "six", 7: "seven",
              8: "eight", 9: "nine", 10: "ten"}


def polarity_token(score: Column) -> Column:
    """Token such as ``polaritynegativethree`` for an integer score from -10 to 10."""
    sign = pair_code(F.signum(score).cast("int"), SIGN_WORDS)
    return F.concat(F.lit("polarity"), sign, pair_code(F.abs(score).cast("int"), SIZE_WORDS))


def scaled_to_unit(df: DataFrame, c: str) -> Column:
    """(x - min) / (max - min) over the whole table."""
    low, high = df.agg(F.min(c)).scalar(), df.agg(F.max(c)).scalar()
    return F.try_divide(F.col(c) - low, high - low)


def softmax_in_group(df: DataFrame, key: str, c: str, out: str) -> DataFrame:
    """exp(x - group maximum) / group sum, by two small grouped tables."""
    top = df.groupBy(key).agg(F.max(c).alias("__top"))
    shifted = df.join(top, key).withColumn("__e", F.exp(F.col(c) - F.col("__top")))
    total = shifted.groupBy(key).agg(F.sum("__e").alias("__z"))
    return shifted.join(total, key).withColumn(out, F.col("__e") / F.col("__z")).drop("__top", "__e", "__z")


def solve_prior_weight(df: DataFrame, p: str, target_mean: float, rounds: int = 4, grid: int = 32) -> float:
    """Weight w in (0, 1) whose corrected mean w p / (w p + (1-w)(1-p)) is ``target_mean``.

    The mean rises with w, so each round scans once for a grid of weights and
    narrows the interval ``grid``-fold.
    """
    low, high = 0.0, 1.0
    x = F.col(p)
    for _ in range(rounds):
        step = (high - low) / grid
        weights = [low + step * i for i in range(1, grid)]
        means = df.agg(*[F.avg(w * x / (w * x + (1 - w) * (1 - x))) for w in weights]).first()
        below = sum(1 for m in means if m < target_mean)
        low, high = low + step * below, low + step * (below + 1)
    return (low + high) / 2
