"""Data-quality checks. Table checks return one verdict row, series checks one row per series."""

from __future__ import annotations

from datetime import date, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidecast.config import LOW_TRAFFIC, METRICS, MISSING_PCT_MAX, STEP_RATIO, STEP_WINDOW
from tidecast.functions import scalars as fn
from tidecast.operators.gaps import with_previous_date


def _one(check: str, passed: Column, aggregated: DataFrame) -> DataFrame:
    return aggregated.select(F.lit(check).alias("check"), fn.verdict(passed).alias("status"), "*")


# ---- table checks -------------------------------------------------------------------------------


def check_row_count(df: DataFrame, minimum: int) -> DataFrame:
    counted = df.agg(F.count(F.lit(1)).alias("row_count"))
    return _one("row_count", F.col("row_count") >= minimum, counted)


def check_no_nulls(df: DataFrame, columns: list[str]) -> DataFrame:
    any_null = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in columns])
    counted = df.agg(F.count_if(any_null).alias("null_count"))
    return _one("no_nulls", F.col("null_count") == 0, counted)


def check_continuity(df: DataFrame, unit: str = "ad_unit", date_col: str = "date") -> DataFrame:
    gaps = with_previous_date(df.select(unit, date_col), unit, date_col)
    counted = gaps.agg(F.count_if(F.col("gap_days") > 1).alias("gap_count"))
    return _one("date_continuity", F.col("gap_count") == 0, counted)


def check_holiday_join(df: DataFrame) -> DataFrame:
    days = F.col("days_to_next_holiday")
    counted = df.agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.count_if("is_holiday").alias("holiday_rows"),
        F.count_if(days.isNull()).alias("null_days_count"),
        F.count_if(F.col("is_holiday") & (days != 0)).alias("edge_case_violations"),
    )
    passed = (
        (F.col("holiday_rows") > 0) & (F.col("null_days_count") == 0) & (F.col("edge_case_violations") == 0)
    )
    return _one("holiday_join", passed, counted)


def _distinct_counts(df: DataFrame, fold: str, **columns: str) -> DataFrame:
    """Distinct values per column and the row count of one fold.

    Spark expands the row once per column and combines equal values on the map side and by value,
    so no task sees all values of a column.
    """
    return df.where(F.col("fold_name") == fold).agg(
        *[F.count_distinct(column).alias(alias) for alias, column in columns.items()],
        F.count(F.lit(1)).alias("total_rows"),
    )


def check_forecast_coverage(forecasts: DataFrame, fold: str, models: int, units: int) -> DataFrame:
    counted = _distinct_counts(forecasts, fold, model_count="model_name", ad_unit_count="ad_unit")
    passed = (F.col("model_count") == models) & (F.col("ad_unit_count") == units)
    return _one("forecast_coverage", passed, counted)


def check_metrics_complete(
    metrics: DataFrame, fold: str, models: int, units: int, n_metrics: int = len(METRICS)
) -> DataFrame:
    counted = _distinct_counts(
        metrics, fold, model_count="model_name", ad_unit_count="ad_unit", metric_count="metric_name"
    )
    passed = (
        (F.col("model_count") == models)
        & (F.col("ad_unit_count") == units)
        & (F.col("metric_count") == n_metrics)
    )
    return _one("metrics_completeness", passed, counted)


def check_finite(metrics: DataFrame, fold: str) -> DataFrame:
    """No NaN, no infinity; only MASE may be NULL."""
    v = F.col("metric_value")
    bad = F.isnan(v) | (F.abs(v) == float("inf")) | (v.isNull() & (F.col("metric_name") != "mase"))
    counted = metrics.where(F.col("fold_name") == fold).agg(F.count_if(bad).alias("invalid_count"))
    return _one("no_infinite_metrics", F.col("invalid_count") == 0, counted)


def check_row_rules(df: DataFrame) -> DataFrame:
    """Split adds up, weekday 1-7, quarter 1-4, a holiday has a name."""
    split = F.col("desktop_impressions") + F.col("mobile_impressions")
    counted = df.agg(
        F.count_if(split != F.col("daily_impressions")).alias("split_violations"),
        F.count_if(~F.col("day_of_week").between(1, 7)).alias("weekday_violations"),
        F.count_if(~F.col("quarter").between(1, 4)).alias("quarter_violations"),
        F.count_if(F.col("is_holiday") & F.col("holiday_name").isNull()).alias("name_violations"),
    )
    bad = F.col("split_violations") + F.col("weekday_violations")
    bad = bad + F.col("quarter_violations") + F.col("name_violations")
    return _one("row_rules", bad == 0, counted)


def check_holiday_span(holidays: DataFrame, start: date, end: date, horizon: int) -> DataFrame:
    """The holiday table covers training and the horizon after it."""
    spanned = holidays.agg(
        F.count(F.lit(1)).alias("holiday_count"),
        F.min("holiday_date").alias("holiday_min"),
        F.max("holiday_date").alias("holiday_max"),
    ).withColumns(
        {
            "covers_training": F.coalesce(
                (F.col("holiday_min") <= F.lit(start)) & (F.col("holiday_max") >= F.lit(end)), F.lit(False)
            ),
            "covers_forecast": F.coalesce(
                F.col("holiday_max") >= F.lit(end + timedelta(days=horizon)), F.lit(False)
            ),
        }
    )
    return _one("holiday_span", F.col("covers_training") & F.col("covers_forecast"), spanned)


def validate_daily(df: DataFrame, minimum: int) -> DataFrame:
    """The four load checks on daily_impressions as rows, from one pass over the table."""
    needed = ("date", "ad_unit", "daily_impressions", "day_of_week")
    missing = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in needed])
    days = F.col("days_to_next_holiday")
    looked = with_previous_date(df.select(*needed, "is_holiday", "days_to_next_holiday"))
    passed = {
        "row_count": F.count(F.lit(1)) >= minimum,
        "no_nulls": F.count_if(missing) == 0,
        "date_continuity": F.count_if(F.col("gap_days") > 1) == 0,
        "holiday_join": (F.count_if("is_holiday") > 0)
        & (F.count_if(days.isNull()) == 0)
        & (F.count_if(F.col("is_holiday") & (days != 0)) == 0),
    }
    verdicts = [
        F.struct(F.lit(check).alias("check"), fn.verdict(test).alias("status")) for check, test in passed.items()
    ]
    return looked.agg(F.array(*verdicts).alias("v")).select(F.inline("v"))


def summarize_checks(checks: DataFrame) -> DataFrame:
    """Overall PASS or REVIEW and how many of the checks passed."""
    counted = checks.agg(
        F.count_if(F.col("status") == "PASS").alias("passed"), F.count(F.lit(1)).alias("total")
    )
    return counted.select(
        fn.verdict(F.col("passed") == F.col("total"), "REVIEW").alias("overall"),
        "passed",
        "total",
        F.concat_ws("/", "passed", "total").alias("summary"),
    )


# ---- series checks ------------------------------------------------------------------------------


def qc_row_count(df: DataFrame, start: date, end: date) -> DataFrame:
    """Rows of each series against the days of the range."""
    expected = F.lit((end - start).days + 1).cast("bigint")
    return df.groupBy("ad_unit").agg(F.count(F.lit(1)).alias("actual_count")).select(
        F.lit("row_count_check").alias("check_name"),
        "ad_unit",
        "actual_count",
        expected.alias("expected_count"),
        fn.verdict(F.col("actual_count") == expected).alias("status"),
    )


def _per_series(df: DataFrame, check: str, bad: Column, column: str) -> DataFrame:
    """Bad rows per series; a series without any is reported as 0 and PASS."""
    counted = df.groupBy("ad_unit").agg(F.count_if(bad).alias(column))
    return counted.select(
        F.lit(check).alias("check_name"), "ad_unit", column, fn.verdict(F.col(column) == 0).alias("status")
    )


def qc_nulls(df: DataFrame) -> DataFrame:
    return _per_series(df, "null_impressions_check", F.col("daily_impressions").isNull(), "null_count")


def qc_negative(df: DataFrame) -> DataFrame:
    volumes = ("daily_impressions", "desktop_impressions", "mobile_impressions")
    negative = reduce(lambda a, b: a | b, [F.col(c) < 0 for c in volumes])
    return _per_series(df, "negative_values_check", negative, "negative_count")


def qc_continuity(df: DataFrame) -> DataFrame:
    gaps = with_previous_date(df.select("ad_unit", "date"))
    return _per_series(gaps, "date_continuity_check", F.col("gap_days") > 1, "gap_count")


def qc_holiday(df: DataFrame) -> DataFrame:
    """Share of rows that fall on a holiday."""
    counted = df.agg(
        F.count_if("is_holiday").alias("holiday_matches"), F.count(F.lit(1)).alias("total_rows")
    )
    return counted.select(
        F.lit("holiday_join_check").alias("check_name"),
        "holiday_matches",
        "total_rows",
        F.round(fn.ratio(F.col("holiday_matches"), F.col("total_rows")) * 100, 2).alias("match_rate_pct"),
        fn.verdict(F.col("holiday_matches") > 0).alias("status"),
    )


def premodel_distribution(
    df: DataFrame, start: date, end: date, threshold: float = MISSING_PCT_MAX
) -> DataFrame:
    """Missing, zero and low-traffic days per series, with flags above ``threshold`` per cent."""
    expected = (end - start).days + 1
    y = F.col("daily_impressions")
    stats = df.groupBy("ad_unit").agg(
        F.count(F.lit(1)).alias("actual_days"),
        F.count_if(y == 0).alias("zero_days"),
        F.count_if(y < LOW_TRAFFIC).alias("low_traffic_days"),
        F.min(y).alias("min_impressions"),
        F.max(y).alias("max_impressions"),
        F.avg(y).alias("mean"),
        F.stddev(y).alias("std"),
    )
    missing = F.round(100.0 * (F.lit(expected) - F.col("actual_days")) / F.lit(expected), 2)
    zero = F.round(100.0 * F.col("zero_days") / F.col("actual_days"), 2)
    return stats.select(
        "ad_unit",
        "actual_days",
        F.lit(expected).cast("bigint").alias("expected_days"),
        missing.alias("missing_pct"),
        "zero_days",
        zero.alias("zero_pct"),
        "low_traffic_days",
        "min_impressions",
        "max_impressions",
        F.round("mean", 0).alias("avg_impressions"),
        F.round("std", 0).alias("stddev_impressions"),
        F.round(fn.ratio(F.col("std"), F.col("mean")), 2).alias("cv"),
        (missing > threshold).alias("flag_missing"),
        (zero > threshold).alias("flag_zeros"),
    )


def premodel_gaps(df: DataFrame) -> DataFrame:
    """The gaps themselves: the day after each gap, the day before it and its length."""
    gaps = with_previous_date(df.select("ad_unit", "date"))
    return gaps.where(F.col("gap_days") > 1).select("ad_unit", "date", "prev_date", "gap_days")


def step_changes(df: DataFrame, window: int = STEP_WINDOW, threshold: float = STEP_RATIO) -> DataFrame:
    """Days where the mean of the next ``window`` rows and of the last ones differ by ``threshold``."""
    y = F.col("daily_impressions")
    back, ahead = (fn.over_rows(["ad_unit"], "date", *span) for span in ((-window, -1), (1, window)))
    rolled = df.select(
        "ad_unit",
        "date",
        "daily_impressions",
        F.sum(y).over(back).alias("sum_back"),
        F.count(y).over(back).alias("n_back"),
        F.sum(y).over(ahead).alias("sum_ahead"),
        F.count(y).over(ahead).alias("n_ahead"),
    ).where((F.col("sum_back") > 0) & (F.col("sum_ahead") > 0))
    # One division of whole numbers per ratio: a ratio on the edge of rounding stays on it.
    back_weight = (F.col("sum_back") * F.col("n_ahead")).cast("double")
    ahead_weight = (F.col("sum_ahead") * F.col("n_back")).cast("double")
    # The comparison is on the rounded ratios.
    return rolled.select(
        "ad_unit",
        "date",
        "daily_impressions",
        F.round(F.col("sum_back") / F.col("n_back"), 0).alias("avg_before"),
        F.round(F.col("sum_ahead") / F.col("n_ahead"), 0).alias("avg_after"),
        F.round(ahead_weight / back_weight, 2).alias("change_ratio"),
        F.round(back_weight / ahead_weight, 2).alias("inverse_ratio"),
    ).where((F.col("change_ratio") >= threshold) | (F.col("inverse_ratio") >= threshold))


def step_summary(steps: DataFrame, threshold: float = STEP_RATIO) -> DataFrame:
    """Per series: how many shift days, the first one and its direction."""
    up = F.min_by(F.col("change_ratio") >= threshold, "date")
    return steps.groupBy("ad_unit").agg(
        F.count(F.lit(1)).alias("shift_count"),
        F.min("date").alias("first_date"),
        F.when(up, F.lit("UP")).otherwise(F.lit("DOWN")).alias("direction"),
    )


def premodel_checks(
    df: DataFrame, holidays: DataFrame, start: date, end: date, horizon: int
) -> DataFrame:
    """The four pre-model checks as PASS or FAIL rows. Reads ``df`` three times: pass a stored table."""

    def row(name: str, source: DataFrame, passed: Column) -> DataFrame:
        return source.agg(passed.alias("passed")).select(
            F.lit(name).alias("check"), fn.verdict(F.col("passed")).alias("status")
        )

    flags = premodel_distribution(df, start, end)
    return reduce(
        DataFrame.unionByName,
        [
            row("distribution", flags, F.count_if(F.col("flag_missing") | F.col("flag_zeros")) == 0),
            check_continuity(df).select("check", "status"),
            row("step_changes", step_changes(df), F.count(F.lit(1)) == 0),
            check_holiday_span(holidays, start, end, horizon).select("check", "status"),
        ],
    )
