"""Not-modified revisits of a web archive, resolved to the response they stand for.

A revisit record has headers but no body: the server answered that nothing
changed. It is resolved to the latest earlier full response with the same
canonical URL. Validators are compared: the entity tags (weak marks aside) if
both records have one, else the last-modified dates; a revisit whose validators
contradict its response is not resolved. The resolved record has the response's
headers, updated by the headers a not-modified answer may change.

The as-of join is one window, split by time so that a URL with any share of
all records is spread over tasks: quantiles of the capture times cut each
URL's records into cells, each cell is searched alone, and a revisit with no
earlier response in its cell takes the last response of the URL's earlier
cells, from a table with one row per cell that holds a response.

Order within a URL is by (captured_at, record_id); a response with the same
time counts as earlier if its id is smaller. Null captured_at sorts first.
Records without a canonical URL (null, or no ``://``) have no response.
Header names are compared in lower case; null headers count as none. Repeated
records each give a row. Columns not named here are unread.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.urls import canonical

# headers a not-modified answer may update; fixed values of the HTTP standard
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "vary")
RANGES = 64
RESOLVED, MISMATCH, UNCHECKED, MISSING = "resolved", "validator_mismatch", "resolved_unchecked", "no_response"


def _strong(tag: Column) -> Column:
    return F.regexp_replace(F.trim(tag), "^W/", "")


def _lower_names(headers: Column) -> Column:
    empty = F.create_map().cast("map<string,string>")
    return F.coalesce(F.transform_keys(headers, lambda k, _: F.lower(k)), empty)


def validator_status(old: Column, new: Column) -> Column:
    """Status of a revisit with header map ``new`` for a response with header map ``old``."""
    tags = old["etag"].isNotNull() & new["etag"].isNotNull()
    dates = old["last-modified"].isNotNull() & new["last-modified"].isNotNull()
    same = F.when(tags, _strong(old["etag"]) == _strong(new["etag"])).when(dates, old["last-modified"] == new["last-modified"])
    return F.when(same, RESOLVED).when(~same, MISMATCH).otherwise(UNCHECKED)


def merged_headers(old: Column, new: Column) -> Column:
    """The response's headers with the permitted ones of the revisit in their place."""
    changed = F.map_filter(new, lambda k, _: k.isin(*PERMITTED))
    kept = F.map_filter(old, lambda k, _: ~F.array_contains(F.map_keys(changed), k))
    return F.map_concat(kept, changed)


def resolve_revisits(records: DataFrame, ranges: int = RANGES) -> DataFrame:
    """(record_id, url_key, response_id, status, headers) for every revisit record.

    ``records`` has record_id, url, captured_at, kind (``response`` or
    ``revisit``; others are ignored) and headers, a map of strings. ``headers``
    is null where the revisit is not resolved.
    """
    slim = records.where(F.col("kind").isin("response", "revisit")).select(
        "record_id", "captured_at", "kind", canonical(F.col("url")).alias("url_key"), _lower_names(F.col("headers")).alias("headers")
    )
    cuts = records.select(
        F.percentile_approx(F.unix_micros(F.col("captured_at").cast("timestamp")), [i / ranges for i in range(1, ranges)]).alias("at")
    ).first()["at"] or []  # at most ``ranges`` times
    moment = F.unix_micros(F.col("captured_at").cast("timestamp"))
    cell = F.lit(0)
    for at in sorted(set(cuts)):
        cell = cell + F.coalesce((moment > at).cast("int"), F.lit(0))
    slim = slim.withColumn("cell", cell)
    response = F.when(F.col("kind") == "response", F.struct(F.col("record_id").alias("id"), "headers"))
    order = [F.col("captured_at").asc_nulls_first(), F.col("record_id")]
    inside = Window.partitionBy("url_key", "cell").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    near = slim.withColumn("near", F.last(response, ignorenulls=True).over(inside)).where("kind = 'revisit'")
    last = (
        slim.where("kind = 'response' and url_key is not null")
        .groupBy("url_key", "cell")
        .agg(F.max_by(F.struct(F.col("record_id").alias("id"), "headers"), F.struct(F.coalesce(moment, F.lit(-(1 << 62))), "record_id")).alias("response"))
    )
    # the cells of a URL that ask for an earlier response, next to those that hold one
    asking = near.where("near is null and url_key is not null").select("url_key", "cell").distinct()
    earlier = Window.partitionBy("url_key").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        last.join(asking.withColumn("asks", F.lit(True)), ["url_key", "cell"], "full")
        .withColumn("far", F.last("response", ignorenulls=True).over(earlier))
        .where("asks").select("url_key", "cell", "far")
    )
    found = near.join(carried, ["url_key", "cell"], "left").withColumn(
        "found", F.when(F.col("url_key").isNotNull(), F.coalesce("near", "far"))
    )
    status = F.when(F.col("found").isNull(), MISSING).otherwise(validator_status(F.col("found.headers"), F.col("headers")))
    done = found.withColumn("status", status)
    good = F.col("status").isin(RESOLVED, UNCHECKED)
    return done.select(
        "record_id", "url_key", F.col("found.id").alias("response_id"), "status",
        F.when(good, merged_headers(F.col("found.headers"), F.col("headers"))).alias("headers"),
    )


VISITS = 4


def crawl_records(pages: DataFrame) -> DataFrame:
    """Archive records made from a table of pages (page_id, url, html): ``VISITS`` captures of each.

    The first capture is a full response. A later one is a response with a new
    body, or a revisit whose tag is that of the latest body, or, at times, an
    old one; some revisits send only the date and some no validator.
    """
    visits = pages.select("page_id", "url", F.md5(F.coalesce("html", F.lit(""))).alias("digest")).withColumn(
        "visit", F.explode(F.array(*[F.lit(v) for v in range(VISITS)]))
    )
    page, visit = F.coalesce("page_id", F.lit(0)), F.col("visit")

    def new_body(v: int) -> Column:
        return (F.pmod(page * 31 + v * 17, F.lit(5)) == 0) if v else F.lit(True)

    body = F.greatest(*[F.when((visit >= v) & new_body(v), v).otherwise(0) for v in range(VISITS)])
    kind = F.when(body == visit, "response").otherwise("revisit")
    fault = F.pmod(page * 7 + visit * 3, F.lit(11))
    tag = F.concat(F.lit('"'), F.col("digest"), F.lit("-"), F.when((kind == "revisit") & (fault == 0), body + 9).otherwise(body), F.lit('"'))
    date = F.concat(F.lit("day "), (F.pmod(page, F.lit(300)) + body * 30).cast("string"))
    seen = F.concat(F.lit("day "), (F.pmod(page, F.lit(300)) + visit * 30).cast("string"))
    answer = F.map_filter(
        F.create_map(
            F.lit("ETag"), F.when((kind == "response") | (fault < 8), tag),
            F.lit("Last-Modified"), F.when((kind == "response") | (fault < 10), date),
            F.lit("Date"), seen,
            F.lit("Content-Type"), F.when(kind == "response", "text/html"),
            F.lit("Content-Length"), F.when(kind == "response", F.concat(F.lit("1"), body.cast("string"))).otherwise("0"),
        ),
        lambda _, v: v.isNotNull(),
    )
    marked = F.when(visit % 2 == 1, F.concat("url", F.when(F.instr("url", "?") > 0, "&utm_source=crawl").when(F.instr("url", "#") > 0, "").otherwise("#again")))
    return visits.select(
        (F.col("page_id") * VISITS + visit).alias("record_id"), F.coalesce(marked, F.col("url")).alias("url"),
        F.timestamp_seconds(1_700_000_000 + (F.pmod(page, F.lit(300)) + visit * 30) * 86_400).alias("captured_at"),
        kind.alias("kind"), answer.alias("headers"),
    )
