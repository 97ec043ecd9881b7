"""The US holiday dimension, generated by rule for any range of years."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _day(month: int, day: int) -> str:
    return f"make_date(year, {month}, {day})"


def _nth(month: int, weekday: str, n: int) -> str:
    """The n-th given weekday of a month."""
    return f"date_add(next_day(date_sub({_day(month, 1)}, 1), '{weekday}'), {7 * (n - 1)})"


# The anonymous Gregorian computus, one step per layer: each names what the next one uses.
_EASTER_STEPS = [
    {"a": "year % 19", "b": "year div 100", "c": "year % 100"},
    {"h": "(19 * a + b - b div 4 - (b - (b + 8) div 25 + 1) div 3 + 15) % 30"},
    {"l": "(32 + 2 * (b % 4) + 2 * (c div 4) - h - c % 4) % 7"},
    {"m": "(a + 11 * h + 22 * l) div 451"},
    {"offset": "(h + l - 7 * m + 114) div 31 * 31 + (h + l - 7 * m + 114) % 31 - 93"},
    {"easter": f"date_add({_day(3, 1)}, cast(offset as int))"},
]

_THANKSGIVING = _nth(11, "Thu", 4)

# Names, importance and the rule of each holiday. Where two fall on one date, the
# later one in this list names the day.
_RULES = [
    ("New Year's Day", True, _day(1, 1)),
    ("Martin Luther King Jr. Day", False, _nth(1, "Mon", 3)),
    ("Super Bowl Sunday", True, _nth(2, "Sun", 2)),
    ("Valentine's Day", False, _day(2, 14)),
    ("Presidents Day", False, _nth(2, "Mon", 3)),
    ("Easter Sunday", True, "easter"),
    ("Mother's Day", True, _nth(5, "Sun", 2)),
    ("Memorial Day", True, f"next_day({_day(5, 24)}, 'Mon')"),
    ("Father's Day", True, _nth(6, "Sun", 3)),
    ("Juneteenth", False, _day(6, 19)),
    ("Independence Day", True, _day(7, 4)),
    ("Labor Day", True, _nth(9, "Mon", 1)),
    ("Columbus Day", False, _nth(10, "Mon", 2)),
    ("Halloween", True, _day(10, 31)),
    ("Veterans Day", False, _day(11, 11)),
    ("Thanksgiving Day", True, _THANKSGIVING),
    ("Black Friday", True, f"date_add({_THANKSGIVING}, 1)"),
    ("Cyber Monday", True, f"date_add({_THANKSGIVING}, 4)"),
    ("Christmas Eve", True, _day(12, 24)),
    ("Christmas Day", True, _day(12, 25)),
    ("New Year's Eve", True, _day(12, 31)),
]


def holiday_dim(spark: SparkSession, first_year: int, last_year: int) -> DataFrame:
    """``holiday_date, holiday_name, is_major``: one row per date, at most 21 per year."""
    years = spark.range(first_year, last_year + 1, numPartitions=1).selectExpr("cast(id as int) as year")
    for step in _EASTER_STEPS:
        years = years.selectExpr("*", *[f"{rule} as {name}" for name, rule in step.items()])
    listed = ", ".join(
        f"""named_struct('order', {order}, 'holiday_name', "{name}", 'is_major', {major}, 'holiday_date', {day})"""
        for order, (name, major, day) in enumerate(_RULES)
    )
    return (
        years.selectExpr(f"inline(array({listed}))")
        .groupBy("holiday_date")
        .agg(
            F.max_by("holiday_name", "order").alias("holiday_name"),
            F.max_by("is_major", "order").alias("is_major"),
        )
    )


def holidays_in_range(holidays: DataFrame, start=None, end=None) -> DataFrame:
    """Rows between two dates, with ``is_major`` read from text or boolean."""
    in_range = F.lit(True)
    if start is not None:
        in_range &= F.col("holiday_date") >= F.lit(start).cast("date")
    if end is not None:
        in_range &= F.col("holiday_date") <= F.lit(end).cast("date")
    return holidays.where(in_range).select(
        "holiday_date",
        "holiday_name",
        (F.lower(F.trim(F.col("is_major").cast("string"))) == "true").alias("is_major"),
    )
