"""Sharding by sampled splitters over the hash of a record's text.

Keys are drawn with a chance that grows with their record's size; quantiles of
the sample cut the key space into ranges of nearly equal bytes. Ranges whose
counted bytes are too many are sampled again and cut again; a single key that
overfills a range by itself (many equal texts) is cut by the hash of its id.
Runs of ranges make the shards. Equal texts share a key and so lie next to
each other; only a key that overfills a range can reach into the next shard.

The law is ``bytes``: a shard differs from the mean by at most about one range,
1/``RANGES_PER_SHARD`` of a shard. Two tables reach the driver, both bounded by
the number of ranges: the sample and the bytes of each range.

Null text has size 1 and a key of its own. Repeated rows are separate records.
Ties of the key are ordered by id. An empty table gives no rows. Input columns
named like an output column (shard, slot) are replaced.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import cut_lineage

RANGES_PER_SHARD = 64
OVERSAMPLE = 16
# a range is overfull beyond this many times its share of all bytes
OVERFULL = 1.5
ROUNDS = 3


def record_size(text: str = "text") -> Column:
    """UTF-8 bytes of the text plus 1."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def record_key(text: str = "text") -> Column:
    return F.xxhash64(F.coalesce(F.md5(F.col(text).cast("binary")), F.lit("")))


class Splitters:
    """Cut points of the key space, and cut points of the id hash inside heavy keys."""

    def __init__(self, keys: list[int], inside: dict[int, list[int]]):
        self.keys, self.inside = sorted(set(keys)), {k: sorted(set(v)) for k, v in inside.items()}
        # the first range number of every cut; a heavy key holds one more range per inner cut
        self.first, at = [0], 0
        for key in self.keys:
            at += 1 + len(self.inside.get(key, ()))
            self.first.append(at)
            if key in self.inside:
                self.first[-1] = at - len(self.inside[key])
        self.count = at + 1

    def of(self, key: Column, inner: Column) -> Column:
        """Range number of a record; numbers grow with (key, inner)."""
        keys, first = np.array(self.keys, np.int64), np.array(self.first, np.int64)
        inside = {k: np.array(v, np.int64) for k, v in self.inside.items()}

        @F.pandas_udf("long")
        def number(k: pd.Series, i: pd.Series) -> pd.Series:
            k, i = k.to_numpy(), i.to_numpy()
            out = first[np.searchsorted(keys, k, "right")]
            for heavy, cuts in inside.items():
                hit = k == heavy
                if hit.any():
                    out[hit] += np.searchsorted(cuts, i[hit], "right")
            return pd.Series(out)

        return number(key, inner)


def _sample(records: DataFrame, rows: int) -> list:
    """``rows`` records, each drawn with weight ``size`` (smallest exponential clocks, hashed)."""
    unit = (F.pmod(F.xxhash64("key", "inner", "size"), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))
    return (
        records.select("key", "inner", (-F.log(unit) / F.col("size")).alias("clock"))
        .orderBy("clock", "key", "inner").limit(rows).collect()
    )


def _quantiles(values: list[int], parts: int) -> list[int]:
    values = sorted(values)
    return [values[len(values) * i // parts] for i in range(1, parts)] if values else []


def find_splitters(records: DataFrame, ranges: int) -> tuple[Splitters, list[tuple[int, int, int]]]:
    """Cut points for records (key, inner, size), and (range, bytes, rows) of each range."""
    drawn = _quantiles([r["key"] for r in _sample(records, ranges * OVERSAMPLE)], ranges)
    keys, inside = set(drawn), {}
    for left, right in zip(drawn, drawn[1:]):
        if left == right:  # one key with more than a range's share stands alone
            keys |= {left, left + 1} if left < (1 << 63) - 1 else {left}
    for round_ in range(ROUNDS + 1):
        splitters = Splitters(list(keys), inside)
        placed = records.withColumn("range", splitters.of(F.col("key"), F.col("inner")))
        found = placed.groupBy("range").agg(
            F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"), F.max("size").alias("largest"),
            F.min("key").alias("low"), F.max("key").alias("high"),
        ).collect()
        total = sum(r["bytes"] for r in found)
        most = OVERFULL * total / ranges
        over = {r["range"]: r for r in found if r["bytes"] > most and r["rows"] > 1 and r["bytes"] > r["largest"]}
        if not over or round_ == ROUNDS:
            break
        again = placed.where(F.col("range").isin(list(over)))
        parts = {n: max(2, round(r["bytes"] * ranges / total)) for n, r in over.items()}
        seen: dict[int, list] = {n: [] for n in over}
        for row in _sample(again, sum(parts.values()) * OVERSAMPLE):
            seen[splitters_of(splitters, row["key"], row["inner"])].append(row)
        for n, r in over.items():
            if r["low"] == r["high"]:
                keys |= {r["low"]} | ({r["low"] + 1} if r["low"] < (1 << 63) - 1 else set())
                inside[r["low"]] = inside.get(r["low"], []) + _quantiles([x["inner"] for x in seen[n]], parts[n])
            else:
                cuts = _quantiles([x["key"] for x in seen[n]], parts[n])
                keys |= set(cuts)
                keys |= {a + 1 for a, b in zip(cuts, cuts[1:]) if a == b and a < (1 << 63) - 1}
                keys |= {r["low"], r["high"]} if len(set(cuts)) < 2 else set()
    return splitters, sorted((r["range"], r["bytes"], r["rows"]) for r in found)


def splitters_of(splitters: Splitters, key: int, inner: int) -> int:
    return splitters.first[bisect_right(splitters.keys, key)] + bisect_right(splitters.inside.get(key, []), inner)


def shard_of_ranges(ranges: list[tuple[int, int, int]], shards: int) -> list[tuple[int, int, int]]:
    """(range, shard, rows of the shard in earlier ranges): runs of ranges of nearly equal bytes."""
    total, before = sum(b for _, b, _ in ranges), 0
    out, rows = [], [0] * shards
    for number, size, n in ranges:
        shard = min(shards - 1, int((2 * before + size) * shards // (2 * total)))
        out.append((number, shard, rows[shard]))
        rows[shard] += n
        before += size
    return out


def _places(keyed: DataFrame, shards: int, ranges_per_shard: int) -> tuple[Splitters, DataFrame]:
    """Splitters of (key, inner, size) records and a table (__range, shard, __before) with one row per range."""
    splitters, found = find_splitters(keyed.select("key", "inner", "size"), shards * ranges_per_shard)
    places = keyed.sparkSession.createDataFrame(
        shard_of_ranges(found, shards), "__range long, shard int, __before long"
    )
    return splitters, places


def _inner(doc_id: str) -> Column:
    return F.xxhash64(F.col(doc_id), F.lit("inside a key"))


def _numbered(records: DataFrame, splitters: Splitters, places: DataFrame, kept: list[str], doc_id: str) -> DataFrame:
    """Place records that carry ``__key``, ``__inner`` and ``__size``."""
    order = Window.partitionBy("__range").orderBy("__key", "__inner", F.col(doc_id), "__size")
    ranged = records.withColumn("__range", splitters.of(F.col("__key"), F.col("__inner")))
    # ``places`` has one row per range, a number set by the parameters
    return ranged.withColumn("__rn", F.row_number().over(order)).join(F.broadcast(places), "__range").select(
        *kept, "shard", (F.col("__before") + F.col("__rn") - 1).cast("long").alias("slot")
    )


def shards_of_keys(keyed: DataFrame, *, shards: int = 8, doc_id: str = "doc_id",
                   ranges_per_shard: int = RANGES_PER_SHARD) -> DataFrame:
    """``shard`` and ``slot`` for records that are known by id, ``key`` and ``size`` only."""
    kept = [c for c in keyed.columns if c not in ("shard", "slot")]
    keyed = cut_lineage(keyed.select(*kept, _inner(doc_id).alias("inner")))
    splitters, places = _places(keyed, shards, ranges_per_shard)
    named = keyed.withColumns({"__key": F.col("key"), "__inner": F.col("inner"), "__size": F.col("size")})
    return _numbered(named, splitters, places, kept, doc_id)


def range_shards(records: DataFrame, *, shards: int = 8, doc_id: str = "doc_id", text: str = "text",
                 ranges_per_shard: int = RANGES_PER_SHARD) -> DataFrame:
    """All columns of ``records`` with ``shard`` and ``slot``, the record's place in its shard from 0."""
    kept = [c for c in records.columns if c not in ("shard", "slot")]
    key, inner, size = record_key(text), _inner(doc_id), record_size(text)
    splitters, places = _places(
        cut_lineage(records.select(key.alias("key"), inner.alias("inner"), size.alias("size"))), shards, ranges_per_shard
    )
    named = records.select(*kept, key.alias("__key"), inner.alias("__inner"), size.alias("__size"))
    return _numbered(named, splitters, places, kept, doc_id)
