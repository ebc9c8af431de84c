"""Similarity of two token lists, two texts or two vectors of the same row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.scalars import safe_ratio
from tessera.functions.text import drop_words


def shared_share(a: Column, b: Column, stop: Sequence[str] = ()) -> Column:
    """Twice the shared distinct words over the distinct words of both; 0 when a side is empty."""
    x, y = F.array_distinct(drop_words(a, stop)), F.array_distinct(drop_words(b, stop))
    shared = 2 * F.size(F.array_intersect(x, y)) / (F.size(x) + F.size(y))
    return F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(shared)


def ratio_second(n1: Column, n2: Column) -> Column:
    """n2 / n1; 0 when the first is 0, null when the second is."""
    return F.when(n2 == 0, None).when(n1 == 0, 0.0).otherwise(F.try_divide(n2, n1))


def overlap_features(a: Column, b: Column, stop: Sequence[str]) -> dict[str, Column]:
    """Word overlap, count and length differences of two token lists."""
    ua, ub = F.array_distinct(a), F.array_distinct(b)
    sa, sb = drop_words(ua, stop), drop_words(ub, stop)
    union = F.array_union(a, b)
    chars = lambda x: F.length(F.array_join(x, ""))
    out = {
        "common_words": F.size(F.array_intersect(a, b)),
        "total_unique_words": F.size(union),
        "total_unique_words_stop": F.size(drop_words(union, stop)),
        "same_start_word": (F.get(a, 0) == F.get(b, 0)).cast("int"),
    }
    for name, x, y in (("wc", a, b), ("wc_unique", ua, ub), ("wc_unique_stop", sa, sb)):
        out[f"{name}_diff"] = F.abs(F.size(x) - F.size(y))
        out[f"{name}_ratio"] = ratio_second(F.size(x), F.size(y))
    out["char_diff"] = F.abs(chars(a) - chars(b))
    out["char_ratio"] = ratio_second(chars(a), chars(b))
    out["char_diff_unique_stop"] = F.abs(chars(sa) - chars(sb))
    return out


def jaccard(a: Column, b: Column) -> Column:
    return safe_ratio(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b)))


def dice(a: Column, b: Column) -> Column:
    x, y = F.array_distinct(a), F.array_distinct(b)
    return safe_ratio(2 * F.size(F.array_intersect(x, y)), F.size(x) + F.size(y))


def vector_distances(x: Column, y: Column) -> dict[str, Column]:
    """Cityblock, Canberra, Euclidean, Minkowski (p = 3) and Bray-Curtis distances."""
    def total(f):
        return F.aggregate(F.zip_with(x, y, f), F.lit(0.0), lambda acc, v: acc + v)

    gap = lambda a, b: F.abs(a.cast("double") - b.cast("double"))
    both = lambda a, b: F.abs(a.cast("double")) + F.abs(b.cast("double"))
    return {
        "cityblock": total(gap),
        "canberra": total(lambda a, b: F.coalesce(F.try_divide(gap(a, b), both(a, b)), F.lit(0.0))),
        "euclidean": F.sqrt(total(lambda a, b: gap(a, b) * gap(a, b))),
        "minkowski3": F.cbrt(total(lambda a, b: gap(a, b) * gap(a, b) * gap(a, b))),
        "braycurtis": F.try_divide(total(gap), total(lambda a, b: F.abs(a.cast("double") + b.cast("double")))),
    }


def edit_ratio(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length; 1 for two empty texts."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.coalesce(1 - F.try_divide(F.levenshtein(a, b), longest), F.lit(1.0))


def text_ratios(a: Column, b: Column) -> dict[str, Column]:
    """Edit ratios of two token lists as they stand, sorted, and split into shared and own words."""
    join = lambda x: F.array_join(x, " ")
    ordered = lambda x: join(F.array_sort(x))
    shared = F.array_sort(F.array_intersect(a, b))
    only = lambda x, y: F.trim(F.concat_ws(" ", join(shared), ordered(F.array_except(x, y))))
    one, two = only(a, b), only(b, a)
    return {
        "plain": edit_ratio(join(a), join(b)),
        "token_sort": edit_ratio(ordered(a), ordered(b)),
        "token_set": F.greatest(edit_ratio(join(shared), one), edit_ratio(join(shared), two), edit_ratio(one, two)),
    }


def length_features(a: Column, b: Column) -> dict[str, Column]:
    """Raw length differences and ratios; a zero length counts as one in the ratio."""
    n1, n2 = F.length(a), F.length(b)
    floor1 = lambda n: F.when(n > 0, n).otherwise(1)
    return {
        "diff_len": n1 - n2,
        "abs_diff_len": F.abs(n1 - n2),
        "log_abs_diff_len": F.log1p(F.abs(n1 - n2).cast("double")),
        "ratio_len": floor1(n1) / floor1(n2),
        "log_ratio_len": F.log1p(floor1(n1) / floor1(n2)),
    }
