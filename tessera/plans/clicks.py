"""Click rows with their dimensions, and the ranking of ads within a display."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.aggregates import smoothed_rate
from tessera.operators.frames import split_path
from tessera.operators.joins import listed_flag, lookup_with_default
from tessera.operators.topk import joined_ids


def click_rows(clicks: DataFrame, ads: DataFrame, displays: DataFrame, leaks: DataFrame) -> DataFrame:
    """Each click with ad, display and geography fields and the leak flag, as ``name=value`` text.

    ``ads`` is (ad_id, document_id, segment), ``displays`` (display_id, platform,
    geo_location ``country>state>dma``), ``leaks`` (ad_document, uuids).
    """
    geo = split_path(F.col("geo_location"), ">", ["loc_country", "loc_state", "loc_dma"], ["", "", ""])
    places = displays.select("display_id", "platform", *geo)
    rows = lookup_with_default(clicks, ads, ["ad_id"], {"document_id": "0", "segment": "0"})
    rows = lookup_with_default(rows, places, ["display_id"], {
        "platform": "0", "loc_country": "0", "loc_state": "0", "loc_dma": "0"})
    rows = listed_flag(rows, leaks, "document_id", "uuid", "uuids", "leakage_row_found")
    names = ["display_id", "ad_id", "document_id", "segment", "uuid", "platform", "loc_country", "loc_state",
             "loc_dma", "leakage_row_found"]
    text = F.concat_ws(" ", *[F.concat(F.lit(f"{n}="), F.col(n).cast("string")) for n in names])
    return rows.select("row_id", "clicked", text.alias("fields"))


def ad_ranking(train: DataFrame, test: DataFrame, weight: float = 16) -> DataFrame:
    """Ad ids of each display by falling smoothed click rate of (ad, platform)."""
    key = F.concat_ws("_", "ad_id", F.when(F.col("platform") < "1", "2").otherwise(F.col("platform")))
    fit = train.withColumn("k", key)
    rates = smoothed_rate(fit, "k", "clicked", weight, "prob")
    overall = train.agg(F.avg("clicked")).scalar()
    scored = test.withColumn("k", key).join(rates, "k", "left").withColumn("prob", F.coalesce("prob", overall))
    best = scored.groupBy("display_id", "ad_id").agg(F.max("prob").alias("prob"))
    return joined_ids(best.withColumn("o", F.struct(-F.round("prob", 9), F.col("ad_id"))), ["display_id"], "ad_id", "ad_ids", order="o")
