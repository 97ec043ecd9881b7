"""Hourly shards to the complete daily table."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tidecast.operators.calendar import daily_totals, with_features
from tidecast.operators.gaps import fill_gaps
from tidecast.operators.quality import validate_daily
from tidecast.operators.rollup import daily_rollup, extract_hourly
from tidecast.sources.tables import read_table, replace_table


def complete_daily(raw: DataFrame, holidays: DataFrame, start, end) -> DataFrame:
    """Build and backfill together: one pass over the counts, features worked out once.

    Two shuffles: by day and series for the totals (combined on the map side), by series for the
    neighbours of a gap.
    """
    return with_features(fill_gaps(daily_totals(raw), start, end).drop("is_filled"), holidays)


def load_daily(
    shards: list[DataFrame], holidays: DataFrame, start, end, titles: list[str] | None = None
) -> DataFrame:
    """Extract, roll up, fill gaps and add features: one lazy plan over the shards."""
    return complete_daily(daily_rollup(extract_hourly(shards, start, end, titles)), holidays, start, end)


def run_load(
    shards: list[DataFrame],
    holidays: DataFrame,
    start,
    end,
    root: str,
    minimum: int,
    titles: list[str] | None = None,
    partitions: list[str] | None = None,
) -> DataFrame:
    """Store ``raw_pageviews``, ``us_holidays`` and ``daily_impressions`` under ``root`` and validate the last.

    Every step reads what the one before it stored, so a run that is cut off is completed by running it
    again. The tables of days have a folder per day, as declared, unless ``partitions`` names other columns
    (or none, where a day is too small for files of its own). Returns the four load checks, each PASS or
    FAIL, over the stored daily table.
    """
    spark = holidays.sparkSession
    path = {name: f"{root}/{name}" for name in ("raw_pageviews", "us_holidays", "daily_impressions")}
    replace_table(daily_rollup(extract_hourly(shards, start, end, titles)), path["raw_pageviews"], "raw_pageviews", partitions)
    replace_table(holidays, path["us_holidays"], "us_holidays")
    raw, named = (read_table(spark, path[name], name) for name in ("raw_pageviews", "us_holidays"))
    replace_table(complete_daily(raw, named, start, end), path["daily_impressions"], "daily_impressions", partitions)
    return validate_daily(read_table(spark, path["daily_impressions"], "daily_impressions"), minimum)
