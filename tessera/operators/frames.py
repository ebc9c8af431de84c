"""Column-set helpers: select by name part, rename, round, cast, tag, stack."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_affix(df: DataFrame, prefix: str = "", suffix: str = "", keep: Sequence[str] = ()) -> DataFrame:
    """Rename every column to ``prefix + name + suffix``, except those in ``keep``."""
    return df.select(
        [F.col(c) if c in keep else F.col(c).alias(f"{prefix}{c}{suffix}") for c in df.columns]
    )


def columns_like(df: DataFrame, prefix: str = "", suffix: str = "") -> list[str]:
    return [c for c in df.columns if c.startswith(prefix) and c.endswith(suffix)]


def rounded(df: DataFrame, digits: int = 6, columns: Iterable[str] | None = None) -> DataFrame:
    """Round the given columns, or all floating-point ones."""
    chosen = set(columns) if columns is not None else {
        c for c, t in df.dtypes if t in ("double", "float")
    }
    # adding 0.0 turns a negative zero into zero
    return df.select([(F.round(c, digits) + F.lit(0.0)).alias(c) if c in chosen else F.col(c) for c in df.columns])


def downcast(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Cast all columns of one type to another, e.g. ``{"double": "float"}``."""
    return df.select([F.col(c).cast(mapping[t]) if t in mapping else F.col(c) for c, t in df.dtypes])


def tagged_union(frames: Mapping[str, DataFrame], tag: str) -> DataFrame:
    """Stack frames by column name, each row tagged with its source."""
    out = None
    for name, df in frames.items():
        part = df.withColumn(tag, F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def melt(df: DataFrame, ids: Sequence[str], values: Sequence[str], name: str = "variable",
         value: str = "value") -> DataFrame:
    return df.unpivot(list(ids), list(values), name, value)


def cast_wide(df: DataFrame, ids: Sequence[str], name: str, labels: Sequence, value: Column) -> DataFrame:
    """Long to wide for a known list of labels; no job is run to find them."""
    return df.groupBy(*ids).pivot(name, list(labels)).agg(value)


def split_path(column: Column, sep: str, names: Sequence[str], default: Sequence[str]) -> list[Column]:
    """Split a path into a fixed number of columns; missing parts get the default."""
    parts = F.split(column, sep)
    return [F.coalesce(F.get(parts, i), F.lit(d)).alias(n) for i, (n, d) in enumerate(zip(names, default))]


def recode(column: Column, mapping: Mapping, default: Column | None = None) -> Column:
    """Replace listed values; others keep their value unless a default is given."""
    out = None
    for old, new in mapping.items():
        out = F.when(column == F.lit(old), F.lit(new)) if out is None else out.when(column == F.lit(old), F.lit(new))
    return out.otherwise(column if default is None else default)


def code_lookup(column: Column, codes: Mapping, missing, default) -> Column:
    """Code of a value from a fixed table; blank or NA takes ``missing``, unknown ``default``."""
    table = F.create_map(*[F.lit(x) for pair in codes.items() for x in pair])
    clean = F.trim(column)
    blank = clean.isNull() | clean.isin("", "NA")
    return F.when(blank, F.lit(missing)).otherwise(F.coalesce(table[clean], F.lit(default)))


def indicator_code(columns: Sequence[Column]) -> Column:
    """Collapse mutually exclusive indicators into one code: sum of position x flag, from 1."""
    total = F.lit(0)
    for i, c in enumerate(columns, start=1):
        total = total + F.lit(i) * c
    return total
