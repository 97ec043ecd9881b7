"""Exploring daily series: distributions, patterns, trends and year-on-year shifts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidecast.config import (
    BASELINE_SHIFT_PCT,
    MARKET_WEEKEND_PCT,
    ROUND_THE_CLOCK_WEEKEND_PCT,
    TREND_PCT,
    YEAR_SHIFT_PCT,
)
from tidecast.functions import scalars as fn
from tidecast.functions.quantiles import exact_quantiles

WEEKDAY_COLUMNS = ("sun", "mon", "tue", "wed", "thu", "fri", "sat")


def distribution_stats(raw: DataFrame) -> DataFrame:
    """Spread of daily volume per series. Quantiles are sketches of bounded size."""
    y = F.col("daily_impressions")
    return raw.groupBy("ad_unit").agg(
        F.count(F.lit(1)).alias("n_days"),
        F.min(y).alias("min_impressions"),
        F.max(y).alias("max_impressions"),
        F.avg(y).alias("mean_impressions"),
        F.stddev(y).alias("std_impressions"),
        F.percentile_approx(y, 0.5, 10_000).alias("median_impressions"),
        F.percentile_approx(y, 0.25, 10_000).alias("p25_impressions"),
        F.percentile_approx(y, 0.75, 10_000).alias("p75_impressions"),
        F.sum(y).alias("total_impressions"),
    )


def device_split_check(raw: DataFrame) -> DataFrame:
    """Totals by device against the total, with their difference."""
    sums = raw.groupBy("ad_unit").agg(
        F.sum("daily_impressions").alias("total_impressions"),
        F.sum("desktop_impressions").alias("desktop_sum"),
        F.sum("mobile_impressions").alias("mobile_sum"),
    )
    computed = F.col("desktop_sum") + F.col("mobile_sum")
    return sums.withColumns(
        {"computed_total": computed, "discrepancy": F.abs(F.col("total_impressions") - computed)}
    )


def device_split_verdict(checked: DataFrame) -> DataFrame:
    return checked.agg(
        (F.count_if(F.col("discrepancy") > 0) == 0).alias("all_splits_valid"),
        F.max("discrepancy").alias("max_discrepancy"),
        F.count_if(F.col("discrepancy") > 0).alias("problem_units"),
    )


def device_mix(checked: DataFrame) -> DataFrame:
    """Desktop share in per cent; 0 without traffic."""
    share = F.coalesce(fn.ratio(F.col("desktop_sum"), F.col("total_impressions")) * 100, F.lit(0.0))
    return checked.select(
        "ad_unit", "total_impressions", "desktop_sum", "mobile_sum", share.alias("desktop_pct")
    )


def weekday_patterns(raw: DataFrame) -> DataFrame:
    return raw.groupBy("ad_unit", fn.day_of_week(F.col("date")).alias("day_of_week")).agg(
        F.avg("daily_impressions").alias("avg_impressions"), F.count(F.lit(1)).alias("n_observations")
    )


def weekday_heatmap(patterns: DataFrame) -> DataFrame:
    """Weekday means over the largest weekday mean, one column per weekday."""

    def mean_of(day: int) -> Column:
        return F.max(F.when(F.col("day_of_week") == day, F.col("avg_impressions")))

    wide = patterns.groupBy("ad_unit").agg(
        F.max("avg_impressions").alias("peak"),
        *[mean_of(i).alias(name) for i, name in enumerate(WEEKDAY_COLUMNS, 1)],
    )
    return wide.select("ad_unit", *[fn.ratio(F.col(c), F.col("peak")).alias(c) for c in WEEKDAY_COLUMNS])


def traffic_sides(stats: DataFrame) -> DataFrame:
    """Each series on its side of the median total: ``high`` above it, else ``low``.

    One row per series, so the two lists may be of any length.
    """
    median = exact_quantiles(stats, "total_impressions", {"median_total": 0.5}, []).select("median_total")
    side = F.when(F.col("total_impressions") > F.col("median_total"), F.lit("high")).otherwise(F.lit("low"))
    return stats.withColumn("median_total", median.scalar()).select(
        "ad_unit", "total_impressions", "median_total", side.alias("side")
    )


def distribution_balance(stats: DataFrame) -> DataFrame:
    """Largest and smallest series, their ratio, and how many lie on each side of the median."""
    sides = traffic_sides(stats)
    total = F.col("total_impressions")
    return sides.agg(
        F.max(total).alias("max_total"),
        F.min(total).alias("min_total"),
        F.max(F.struct(total, "ad_unit"))["ad_unit"].alias("max_ad_unit"),
        F.min(F.struct(total, "ad_unit"))["ad_unit"].alias("min_ad_unit"),
        F.count_if(F.col("side") == "high").alias("high_traffic_units"),
        F.count_if(F.col("side") == "low").alias("low_traffic_units"),
    ).withColumn(
        "max_min_ratio",
        F.when(F.col("min_total") > 0, F.round(F.col("max_total") / F.col("min_total"), 1)).otherwise(
            F.lit(float("inf"))
        ),
    )


def holiday_impact(raw: DataFrame, holidays: DataFrame) -> DataFrame:
    """Mean volume on each major holiday."""
    major = holidays.where("is_major").select(F.col("holiday_date").alias("date"), "holiday_name")
    return raw.join(major, "date").groupBy("ad_unit", "holiday_name").agg(
        F.avg("daily_impressions").alias("avg_impressions_on_holiday")
    )


def moving_averages(df: DataFrame) -> DataFrame:
    """Centred means of 7 and 30 rows; NULL where the window is not full."""

    def centred(before: int, after: int) -> Column:
        w = fn.over_rows(["ad_unit"], "date", -before, after)
        full = F.count("daily_impressions").over(w) == before + after + 1
        return F.when(full, F.avg("daily_impressions").over(w))

    return df.select(
        "ad_unit",
        "date",
        "daily_impressions",
        centred(3, 3).alias("rolling_7d"),
        centred(15, 14).alias("rolling_30d"),
    )


# ---- weekend and trend diagnosis ----------------------------------------------------------------


def _weekend_means(df: DataFrame, by: list[Column | str]) -> DataFrame:
    weekend = fn.is_weekend(F.col("date"))
    y = F.col("daily_impressions")
    means = df.groupBy(*by).agg(
        F.avg(F.when(~weekend, y)).alias("weekday_mean"), F.avg(F.when(weekend, y)).alias("weekend_mean")
    )
    effect = fn.ratio(F.col("weekend_mean") - F.col("weekday_mean"), F.col("weekday_mean"))
    return means.withColumn("effect", effect)


def _weekend_columns() -> list[Column]:
    return [
        F.round("weekday_mean", 0).alias("weekday_avg"),
        F.round("weekend_mean", 0).alias("weekend_avg"),
        F.round(F.col("effect") * 100, 1).alias("weekend_effect_pct"),
    ]


def weekend_effect_by_year(df: DataFrame) -> DataFrame:
    means = _weekend_means(df, ["ad_unit", F.year("date").cast("bigint").alias("year")])
    return means.select("ad_unit", "year", *_weekend_columns())


def weekend_pattern(df: DataFrame) -> DataFrame:
    """Weekend effect per series with its class."""
    effect = F.col("effect")
    pattern = (
        F.when(effect < -0.15, F.lit("Strong weekday bias"))
        .when(effect < -0.05, F.lit("Moderate weekday bias"))
        .when(effect > 0.05, F.lit("Weekend increase"))
        .otherwise(F.lit("Relatively flat"))
    )
    means = _weekend_means(df, ["ad_unit"])
    return means.select("ad_unit", *_weekend_columns(), pattern.alias("pattern_type"))


def compare_weekend(pattern: DataFrame, round_the_clock: str, market: str) -> DataFrame:
    """Does one series keep its weekend traffic while another loses it?"""

    def effect_of(unit):
        return F.max(F.when(F.col("ad_unit") == unit, F.col("weekend_effect_pct")))

    pair = pattern.agg(effect_of(round_the_clock).alias("effect_a"), effect_of(market).alias("effect_b"))
    confirmed = (F.col("effect_b") < MARKET_WEEKEND_PCT) & (F.col("effect_a") > ROUND_THE_CLOCK_WEEKEND_PCT)
    return pair.select(
        "effect_a",
        "effect_b",
        F.round(F.abs(F.col("effect_a") - F.col("effect_b")), 1).alias("difference"),
        F.when(F.col("effect_a").isNull() | F.col("effect_b").isNull(), F.lit("INSUFFICIENT_DATA"))
        .when(confirmed, F.lit("CONFIRMED"))
        .otherwise(F.lit("NOT_CONFIRMED"))
        .alias("finding"),
    )


def monthly_trend(df: DataFrame) -> DataFrame:
    """Monthly mean, least and greatest day, and the change against the month before."""
    y = F.col("daily_impressions")
    monthly = df.groupBy("ad_unit", F.trunc("date", "MM").alias("month_start")).agg(
        F.avg(y).alias("mean"), F.min(y).alias("least"), F.max(y).alias("greatest")
    )
    previous = F.lag("mean").over(Window.partitionBy("ad_unit").orderBy("month_start"))
    change = fn.ratio(F.col("mean") - previous, previous) * 100
    return monthly.select(
        "ad_unit",
        F.date_format("month_start", "yyyy-MM").alias("month"),
        F.round("mean", 0).alias("avg_daily"),
        F.col("least").alias("min_daily"),
        F.col("greatest").alias("max_daily"),
        F.round(change, 1).alias("mom_change_pct"),
    )


def trend_summary(monthly: DataFrame) -> DataFrame:
    """First and last month, overall change, variation, and winter against summer, per series."""
    mean = F.col("avg_daily")
    winter = F.substring("month", 6, 2).isin("10", "11", "12", "01", "02", "03")
    summary = monthly.groupBy("ad_unit").agg(
        F.min_by(mean, "month").alias("first_avg"),
        F.max_by(mean, "month").alias("last_avg"),
        fn.ratio(F.stddev(mean), F.avg(mean)).alias("variation"),
        F.avg(F.when(winter, mean)).alias("winter_avg"),
        F.avg(F.when(~winter, mean)).alias("summer_avg"),
    )
    change = F.coalesce(fn.ratio(F.col("last_avg") - F.col("first_avg"), F.col("first_avg")) * 100, F.lit(0.0))
    return summary.select(
        "ad_unit",
        "first_avg",
        "last_avg",
        change.alias("overall_change_pct"),
        (F.col("variation") * 100).alias("variation_pct"),
        "winter_avg",
        "summer_avg",
        F.when(F.col("summer_avg") > 0, F.col("winter_avg") / F.col("summer_avg")).alias("seasonal_ratio"),
        F.when(F.abs(change) > TREND_PCT, F.lit("STRONG_TREND")).otherwise(F.lit("SEASONAL")).alias("finding"),
    )


def yearly_baseline(df: DataFrame) -> DataFrame:
    y = F.col("daily_impressions")
    stats = df.groupBy("ad_unit", F.year("date").cast("bigint").alias("year")).agg(
        F.avg(y).alias("mean"),
        F.stddev(y).alias("std"),
        F.min(y).alias("min_daily"),
        F.max(y).alias("max_daily"),
        F.count(F.lit(1)).alias("days"),
    )
    return stats.select(
        "ad_unit",
        "year",
        F.round("mean", 0).alias("avg_daily"),
        F.round("std", 0).alias("stddev"),
        F.round(fn.ratio(F.col("std"), F.col("mean")), 2).alias("cv"),
        "min_daily",
        "max_daily",
        "days",
    )


def year_shift(
    table: DataFrame, column: str, first: int, second: int, relative: bool, threshold: float | None = None
) -> DataFrame:
    """Shift of a yearly value between two years, in points or in per cent, and its verdict."""
    limit = threshold if threshold is not None else (BASELINE_SHIFT_PCT if relative else YEAR_SHIFT_PCT)

    def value_in(year):
        return F.max(F.when(F.col("year") == year, F.col(column)))

    pair = table.groupBy("ad_unit").agg(value_in(first).alias("value_first"), value_in(second).alias("value_second"))
    difference = F.col("value_second") - F.col("value_first")
    shift = fn.ratio(difference, F.col("value_first")) * 100 if relative else difference
    return pair.withColumn("shift", shift).withColumn(
        "finding",
        F.when(F.col("shift").isNull(), F.lit("INSUFFICIENT_DATA"))
        .when(F.abs("shift") > limit, F.lit("SIGNIFICANT"))
        .otherwise(F.lit("STABLE")),
    )


def month_yoy(df: DataFrame, first: int, second: int) -> DataFrame:
    """The same month in two years side by side."""

    def mean_in(year):
        return F.avg(F.when(F.year("date") == year, F.col("daily_impressions")))

    months = df.groupBy("ad_unit", F.month("date").cast("bigint").alias("month")).agg(
        mean_in(first).alias("avg_first"), mean_in(second).alias("avg_second")
    )
    change = fn.ratio(F.col("avg_second") - F.col("avg_first"), F.col("avg_first")) * 100
    return months.withColumn("yoy_change", F.bround(change, 1))


# ---- search-term coverage -----------------------------------------------------------------------


def match_terms(units: DataFrame, terms: DataFrame, unit: str = "ad_unit", term: str = "term") -> DataFrame:
    """Which units occur among the terms, ignoring case and with ``_`` read as a space.

    The either-or condition becomes an equality: each unit is looked up under both spellings.
    """
    lowered = F.lower(F.col(unit))
    spellings = F.array_distinct(F.array(lowered, F.replace(lowered, F.lit("_"), F.lit(" "))))
    wanted = units.select(unit).distinct().select(unit, F.explode(spellings).alias("spelling"))
    known = terms.select(F.lower(F.col(term)).alias("spelling"), F.lit(True).alias("hit")).distinct()
    return wanted.join(known, "spelling", "left").groupBy(unit).agg(
        F.coalesce(F.bool_or("hit"), F.lit(False)).alias("found")
    )


def term_coverage(terms: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Distinct weeks, first and last week and mean score per term."""
    kept = terms if names is None else terms.where(F.col("term").isin(names))
    weekly = kept.groupBy("term", "week").agg(F.sum("score").alias("total"), F.count("score").alias("n"))
    return weekly.groupBy("term").agg(
        F.count("week").alias("weeks_with_data"),
        F.min("week").alias("first_week"),
        F.max("week").alias("last_week"),
        fn.ratio(F.sum("total"), F.sum("n")).alias("avg_score"),
    )
