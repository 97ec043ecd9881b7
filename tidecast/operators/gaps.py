"""Finding and filling missing days."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidecast.functions import scalars as fn
from tidecast.operators.calendar import CALENDAR, HOLIDAY, with_features

VOLUMES = ("daily_impressions", "desktop_impressions", "mobile_impressions")


def with_previous_date(df: DataFrame, unit: str = "ad_unit", date_col: str = "date") -> DataFrame:
    """Adds ``prev_date`` and ``gap_days`` (1 when no day is missing)."""
    previous = F.lag(date_col).over(Window.partitionBy(unit).orderBy(date_col))
    return df.withColumn("prev_date", previous).withColumn(
        "gap_days", fn.days_between(F.col(date_col), F.col("prev_date"))
    )


def fill_gaps(df: DataFrame, start, end, columns=VOLUMES) -> DataFrame:
    """Rows of ``df`` plus the missing days inside each series, marked by ``is_filled``.

    A missing day gets the rounded midpoint of its known neighbours, the same one on every day of
    a longer gap; days before the first or after the last known day stay absent, and so does
    anything outside ``start``..``end``. Equal to completing the date grid and looking both ways,
    but in one pass over ``df``: each row looks at its successor and also emits the days in
    between. Nothing is generated for days that exist. A series has at most one row per day, which
    bounds the window. On filled rows the columns other than date, series and volumes are NULL.
    """
    inside = F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date"))
    w = Window.partitionBy("ad_unit").orderBy("date")
    behind = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    main = columns[0]
    # What lies outside the range is blank, so the windows need no key beyond the series.
    seen = {c: F.when(inside, F.col(c)).alias(f"in_{c}") for c in ("date", *columns)}
    looked = df.select("*", *seen.values()).select(
        "*",
        F.lead("in_date").over(w).alias("next_date"),
        *[F.last(f"in_{c}", ignorenulls=True).over(behind).alias(f"prev_{c}") for c in columns],
        # A frame that ends with the partition would be read anew for every row; this is one pass.
        *[F.expr(f"lead(in_{c}) IGNORE NULLS OVER (PARTITION BY ad_unit ORDER BY date)").alias(f"next_{c}") for c in columns],
    )
    interior = (
        F.col("in_date").isNotNull()
        & (F.datediff("next_date", "date") > 1)
        & F.col(f"prev_{main}").isNotNull()
        & F.col(f"next_{main}").isNotNull()
    )
    last_day = F.when(interior, F.date_sub("next_date", 1)).otherwise(F.col("date"))
    days = looked.select("*", F.explode(F.sequence(F.col("date"), last_day)).alias("day"))
    filled = F.col("day") != F.col("date")

    def value(c: str):
        if c == "date":
            return F.col("day").alias("date")
        if c == "ad_unit":
            return F.col(c)
        if c in columns:
            midpoint = F.round((F.col(f"prev_{c}") + F.col(f"next_{c}")) / F.lit(2.0)).cast("bigint")
            return F.when(filled, midpoint).otherwise(F.col(c)).alias(c)
        return F.when(~filled, F.col(c)).alias(c)

    return days.select(*[value(c) for c in df.columns], filled.alias("is_filled"))


def gap_fills(df: DataFrame, start, end, columns=VOLUMES) -> DataFrame:
    """Only the filled days."""
    kept = df.select("date", "ad_unit", *columns)
    return fill_gaps(kept, start, end, columns).where("is_filled").drop("is_filled")


def backfill_gaps(daily: DataFrame, holidays: DataFrame, start, end) -> DataFrame:
    """A daily table plus its filled days with their own features; existing rows are unchanged.

    A filled day is absent by construction, so no lookup against the target is needed, and running
    it again adds nothing.
    """
    features = [*CALENDAR, *HOLIDAY]
    old = {c: f"old_{c}" for c in features}
    filled = fill_gaps(daily.withColumnsRenamed(old), start, end)
    named = with_features(filled, holidays)
    return named.select(
        *[
            F.when(F.col("is_filled"), F.col(c)).otherwise(F.col(old[c])).alias(c) if c in old else F.col(c)
            for c in daily.columns
        ]
    )
