"""Hourly counts to daily series."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DESKTOP, MOBILE = "en", "en.m"  # fixed values: the two sites that are counted


def extract_hourly(
    shards: list[DataFrame], start, end, titles: list[str] | None = None, wikis=(DESKTOP, MOBILE)
) -> DataFrame:
    """Append shards and keep a time range (``end`` day inclusive), a title list and two sites.

    The conditions are plain comparisons on stored columns, so they reach each shard's scan.
    """
    hourly = reduce(DataFrame.unionByName, [s.select("datehour", "wiki", "title", "views") for s in shards])
    stored = hourly.schema["datehour"].dataType  # bounds take the column's type, so no cast hides it
    first = F.lit(start).cast("date").cast(stored)
    after = F.date_add(F.lit(end).cast("date"), 1).cast(stored)
    hour = F.col("datehour")
    hourly = hourly.where((hour >= first) & (hour < after) & F.col("wiki").isin(*wikis))
    return hourly if titles is None else hourly.where(F.col("title").isin(*titles))


def daily_rollup(hourly: DataFrame) -> DataFrame:
    """One row per day and title with the split by device.

    Summed on the map side first, so a title with a third of all hours sends only one row per day
    from each task into the shuffle.
    """

    def views_of(wiki: str):
        return F.sum(F.when(F.col("wiki") == wiki, F.col("views")).otherwise(F.lit(0)))

    return hourly.groupBy(F.to_date("datehour").alias("date"), F.col("title").alias("ad_unit")).agg(
        F.lit(DESKTOP).alias("wiki"),
        F.sum("views").cast("bigint").alias("daily_impressions"),
        views_of(DESKTOP).cast("bigint").alias("desktop_impressions"),
        views_of(MOBILE).cast("bigint").alias("mobile_impressions"),
    )
