"""URL filter: host and path rules, and a list of blocked URLs behind a blocked Bloom filter.

Listed URLs are held in canonical form. Each one sets ``BITS`` bits of one
64-bit block; the filter is a table (block, word) whose number of blocks
follows the number of listed URLs. A page whose bits are not all set is not
listed. The others, true hits and a few false ones, are joined exactly to the
listed URLs, so the filter changes the cost and never the verdict.

The filter is broadcast if its counted size is within ``BROADCAST_BYTES``, and
joined by block otherwise. Only DataFrame operations are used.

A page with a null URL or one without ``://`` has an empty host and path, fits
no rule and is never listed: it is allowed. Repeated pages and repeated listed
URLs are fine; an empty list blocks nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.urls import canonical, host, path
from tessera.session import cut_lineage

BITS = 4
URLS_PER_BLOCK = 4
BROADCAST_BYTES = 32 << 20


def split_rule(rule: str) -> tuple[str, str]:
    """``example.com/en/`` -> its host and its path."""
    name, slash, rest = rule.partition("/")
    return name, slash + rest


def matching_rule(name: Column, where: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The longest rule (verdict, rule) that fits host and path; null if none does."""
    hits = []
    for _, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        rule_host, rule_path = split_rule(rule)
        fits = ((name == rule_host) | name.endswith("." + rule_host)) & where.startswith(rule_path)
        hits.append(F.when(fits, F.lit(rule)))
    return F.coalesce(*hits) if hits else F.lit(None).cast("string")


def _block(url: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(url, F.lit("block")), F.lit(blocks))


def _mask(url: Column) -> Column:
    """The ``BITS`` bits a URL sets in its block, from six bits of one hash each."""
    h = F.xxhash64(url, F.lit("bits"))
    out = F.lit(0).cast("long")
    for i in range(BITS):
        out = out.bitwiseOR(_bit(h, 6 * i))
    return out


def _bit(h: Column, shift: int) -> Column:
    place = F.shiftrightunsigned(h, shift).bitwiseAND(F.lit(63)).cast("int")
    return F.call_function("shiftleft", F.lit(1).cast("long"), place)


def bloom_blocks(listed: DataFrame, count: int) -> tuple[DataFrame, int]:
    """(block, word) of the filter of the column ``url`` of ``listed``, and the number of blocks."""
    blocks = max(1, -(-count // URLS_PER_BLOCK))
    return listed.groupBy(_block(F.col("url"), blocks).alias("block")).agg(F.bit_or(_mask(F.col("url"))).alias("word")), blocks


def possible_hits(pages: DataFrame, column: str, listed: DataFrame) -> DataFrame:
    """Rows of ``pages`` whose ``column`` the filter of ``listed`` lets through."""
    count = listed.count()
    words, blocks = bloom_blocks(listed, count)
    if 16 * blocks <= BROADCAST_BYTES:
        words = F.broadcast(words)  # at most ``blocks`` rows of 16 bytes
    mask = _mask(F.col(column))
    return (
        pages.withColumn("__block", _block(F.col(column), blocks))
        .join(words.withColumnRenamed("block", "__block").withColumnRenamed("word", "__word"), "__block")
        .where(F.col("__word").bitwiseAND(mask) == mask)
        .drop("__block", "__word")
    )


def judge_urls(pages: DataFrame, listed: DataFrame, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """(page_id, host, path, rule, listed, verdict) for every page.

    ``rules`` are (verdict, host + path) pairs; ``listed`` has the column
    ``url`` of blocked URLs in any form.
    """
    url = F.col("url")
    judged = pages.select(
        "page_id", host(url).alias("host"), path(url).alias("path"), canonical(url).alias("__canonical")
    )
    judged = judged.withColumn("rule", matching_rule(F.col("host"), F.col("path"), rules))
    blocked = cut_lineage(listed.select(canonical(url).alias("url")).where("url is not null").distinct())
    asked = judged.where("rule is null and __canonical is not null").select("__canonical").distinct()
    found = possible_hits(asked, "__canonical", blocked).join(
        blocked.withColumnRenamed("url", "__canonical"), "__canonical", "left_semi"
    ).withColumn("__listed", F.lit(True))
    by_rule = F.lit(None).cast("string")
    for verdict, rule in rules:
        by_rule = F.when(F.col("rule") == rule, verdict).otherwise(by_rule)
    listed_url = F.coalesce("__listed", F.lit(False))
    return judged.join(found, "__canonical", "left").select(
        "page_id", "host", "path", "rule", listed_url.alias("listed"),
        F.coalesce(by_rule, F.when(listed_url, "block").otherwise("allow")).alias("verdict"),
    )
