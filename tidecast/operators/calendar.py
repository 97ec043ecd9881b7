"""Calendar and holiday features of daily series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidecast.functions import scalars as fn

CALENDAR = ("day_of_week", "is_weekend", "quarter", "week_of_year")
HOLIDAY = ("is_holiday", "holiday_name", "days_to_next_holiday")
REGRESSORS = ("day_of_week", "is_weekend", "is_holiday", "days_to_next_holiday")


def _days(start, end):
    return F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("date")


def date_spine(spark: SparkSession, start, end) -> DataFrame:
    """Every date of an inclusive range."""
    return spark.range(1).select(_days(start, end))


def full_grid(df: DataFrame, start, end, unit: str = "ad_unit") -> DataFrame:
    """Every date of a range for every series: a generator per series, not a join."""
    return df.select(unit).distinct().select(_days(start, end), unit)


def holiday_lookup(holidays: DataFrame) -> DataFrame:
    """``date, next_holiday, names`` for each day from the first holiday to the last; ``names`` on holidays only.

    Turns "first holiday on or after a date" from a range join into a lookup by date. Each holiday
    covers the days after the one before it. One row per calendar day, whatever the size of the data.
    """
    before = F.lag("holiday_date").over(Window.orderBy("holiday_date"))
    dates = (
        holidays.where(F.col("holiday_date").isNotNull())
        .groupBy("holiday_date")
        .agg(F.collect_list(F.struct("holiday_name")).alias("names"))
    )
    covered = F.sequence(F.coalesce(F.date_add(before, 1), F.col("holiday_date")), F.col("holiday_date"))
    return dates.select("holiday_date", "names", covered.alias("covered")).select(
        F.explode("covered").alias("date"), F.col("holiday_date").alias("next_holiday"), "names"
    ).withColumn("names", F.when(F.col("date") == F.col("next_holiday"), F.col("names")))


def next_holiday(dates: DataFrame, holidays: DataFrame, date_col: str = "date") -> DataFrame:
    """Adds ``next_holiday`` and ``days_to_next_holiday``; NULL after the last holiday."""
    lookup = holiday_lookup(holidays).select(F.col("date").alias(date_col), "next_holiday")
    found = dates.join(lookup, date_col, "left").withColumn(
        "next_holiday", F.coalesce("next_holiday", _first_holiday(holidays, date_col))
    )
    return found.withColumn("days_to_next_holiday", fn.days_between(F.col("next_holiday"), F.col(date_col)))


def _first_holiday(holidays: DataFrame, date_col: str):
    """The first holiday for days before it, which the lookup does not list."""
    first = holidays.agg(F.min("holiday_date")).scalar()
    return F.when(F.col(date_col) < first, first)


def one_per_date(holidays: DataFrame) -> DataFrame:
    """``holiday_date, holiday_name``: the names of a date joined, for models with one row per day."""
    names = F.array_join(F.array_sort(F.collect_set("holiday_name")), " + ")
    return holidays.groupBy("holiday_date").agg(names.alias("holiday_name"))


def with_calendar(df: DataFrame, date_col: str = "date") -> DataFrame:
    d = F.col(date_col)
    return df.withColumns(
        {
            "day_of_week": fn.day_of_week(d),
            "is_weekend": fn.is_weekend(d),
            "quarter": F.quarter(d).cast("bigint"),
            "week_of_year": fn.week_of_year(d),
        }
    )


def with_holidays(df: DataFrame, holidays: DataFrame) -> DataFrame:
    """Holiday flag, name and days to the next one, by a single lookup.

    A date with two holidays gives two rows, one per name.
    """
    joined = df.join(holiday_lookup(holidays), "date", "left")
    following = F.coalesce("next_holiday", _first_holiday(holidays, "date"))
    days = fn.days_between(following, F.col("date"))
    named = joined.select(*[F.col(c) for c in df.columns], days.alias("days_to_next_holiday"), F.explode_outer("names").alias("named"))
    return named.withColumns(
        {"is_holiday": F.coalesce(F.col("days_to_next_holiday") == 0, F.lit(False)), "holiday_name": F.col("named.holiday_name")}
    ).drop("named")


def with_features(df: DataFrame, holidays: DataFrame) -> DataFrame:
    keep = df.columns
    return with_holidays(with_calendar(df), holidays).select(*keep, *CALENDAR, *HOLIDAY)


def daily_totals(raw: DataFrame) -> DataFrame:
    """One row per day and series over the sites. Keeps the partitioning of the rollup before it."""
    volumes = ("daily_impressions", "desktop_impressions", "mobile_impressions")
    return raw.groupBy("date", "ad_unit").agg(*[F.sum(c).cast("bigint").alias(c) for c in volumes])


def build_daily(raw: DataFrame, holidays: DataFrame) -> DataFrame:
    """Daily series with features, from raw daily counts."""
    return with_features(daily_totals(raw), holidays)


def future_features(df: DataFrame, holidays: DataFrame, start, end) -> DataFrame:
    """Features for a future range, one row per date and series."""
    return with_features(full_grid(df, start, end), holidays)


def xreg_features(df: DataFrame) -> DataFrame:
    """The four regressors as whole numbers; no next holiday counts as 0 days."""
    return df.withColumns(
        {
            "is_weekend": F.col("is_weekend").cast("bigint"),
            "is_holiday": F.col("is_holiday").cast("bigint"),
            "days_to_next_holiday": F.coalesce(F.col("days_to_next_holiday"), F.lit(0)).cast("bigint"),
        }
    )
