"""Reading the forecast decomposition and the fitted orders."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidecast.config import WEEKEND_DIP, WEEKEND_DIP_STRONG, WEEKLY_SWING, YEARLY_SWING
from tidecast.functions import scalars as fn


def decomposition_stats(decomposition: DataFrame, fold: str) -> DataFrame:
    """Weekly, yearly and holiday strength per series against its mean forecast, in one pass."""
    weekend = fn.is_weekend(F.col("forecast_date"))
    weekly, yearly, holiday = (
        F.col(c) for c in ("seasonal_period_weekly", "seasonal_period_yearly", "holiday_effect")
    )
    stats = (
        decomposition.where(F.col("fold_name") == fold)
        .groupBy("ad_unit")
        .agg(
            F.avg(F.when(weekend, weekly)).alias("weekend"),
            F.avg(F.when(~weekend, weekly)).alias("weekday"),
            (F.max(weekly) - F.min(weekly)).alias("weekly_range"),
            (F.max(yearly) - F.min(yearly)).alias("yearly_range"),
            F.avg(F.abs(holiday)).alias("holiday_mean"),
            F.max(F.abs(holiday)).alias("holiday_max"),
            F.avg("forecast_value").alias("base"),
        )
    )

    def share(part: Column) -> Column:
        return F.round(fn.ratio(part, F.col("base")), 3)

    return stats.select(
        "ad_unit",
        F.round("weekend", 2).alias("weekend_component"),
        F.round("weekday", 2).alias("weekday_component"),
        share(F.col("weekend") - F.col("weekday")).alias("weekend_effect"),
        share(F.col("weekly_range")).alias("weekly_amplitude"),
        share(F.col("yearly_range")).alias("yearly_amplitude"),
        F.round("holiday_mean", 2).alias("avg_holiday_effect"),
        F.round("holiday_max", 2).alias("max_holiday_effect"),
        share(F.col("holiday_max")).alias("holiday_impact_pct"),
        F.round("base", 0).alias("avg_forecast"),
    )


def component_stats(decomposition: DataFrame) -> DataFrame:
    """Range of trend and weekly part, largest holiday effect, per series and fold."""
    return decomposition.groupBy("fold_name", "ad_unit").agg(
        (F.max("trend") - F.min("trend")).alias("trend_range"),
        (F.max("seasonal_period_weekly") - F.min("seasonal_period_weekly")).alias("weekly_range"),
        (F.max("seasonal_period_yearly") - F.min("seasonal_period_yearly")).alias("yearly_range"),
        F.max(F.abs("holiday_effect")).alias("max_holiday_effect"),
    )


def holiday_effects(decomposition: DataFrame, unit: str, fold: str) -> DataFrame:
    """Dates on which a holiday moves the forecast of one series."""
    rows = decomposition.where((F.col("ad_unit") == unit) & (F.col("fold_name") == fold))
    return rows.where(F.abs("holiday_effect") > 0).select(
        F.col("forecast_date").alias("date"), "holiday_effect"
    )


def annotate_holidays(decomposition: DataFrame, holidays: DataFrame, unit: str, fold: str) -> DataFrame:
    """Major holidays within one decomposition and their effect there (NULL where it is zero)."""
    own = decomposition.where((F.col("ad_unit") == unit) & (F.col("fold_name") == fold))
    bounds = F.struct(F.min("forecast_date").alias("first"), F.max("forecast_date").alias("last"))
    span = own.agg(bounds.alias("span")).scalar()
    shown = holidays.where(F.col("is_major") & F.col("holiday_date").between(span["first"], span["last"]))
    effects = holiday_effects(decomposition, unit, fold).withColumnRenamed("date", "holiday_date")
    return shown.join(effects, "holiday_date", "left").select("holiday_date", "holiday_name", "holiday_effect")


# ---- expected patterns --------------------------------------------------------------------------

# What each pattern compares with which threshold.
HYPOTHESES: dict[str, tuple[str, str, float]] = {
    "weekend_dip": ("weekend_effect", "<", -WEEKEND_DIP),
    "strong_weekend_dip": ("weekend_effect", "<", -WEEKEND_DIP_STRONG),
    "weekly_swing": ("weekly_amplitude", ">", WEEKLY_SWING),
    "yearly_swing": ("yearly_amplitude", ">", YEARLY_SWING),
    "manual": ("avg_forecast", "any", 0.0),
}


def check_hypotheses(stats: DataFrame, rules: dict[str, str]) -> DataFrame:
    """PASS, REVIEW or MISSING for each series and the pattern expected of it.

    ``rules`` maps a series to a key of ``HYPOTHESES``; a missing strength counts as 0.
    """
    spark = stats.sparkSession
    expected = spark.createDataFrame(list(rules.items()), "ad_unit string, hypothesis string")
    passed = F.lit(None).cast("boolean")
    for name, (column, sign, limit) in HYPOTHESES.items():
        v = F.coalesce(F.col(column), F.lit(0.0))
        test = {"<": v < limit, ">": v > limit, "any": F.lit(True)}[sign]
        passed = F.when(F.col("hypothesis") == name, test).otherwise(passed)
    # The rule list is hand-kept, so it is the small side; the series side is filtered by it.
    known = stats.join(expected.select("ad_unit"), "ad_unit", "left_semi").withColumn("found", F.lit(True))
    status = F.when(F.col("found").isNull(), F.lit("MISSING")).otherwise(fn.verdict(passed, "REVIEW"))
    return expected.join(known, "ad_unit", "left").select("ad_unit", "hypothesis", status.alias("status"))


# ---- fitted orders ------------------------------------------------------------------------------


def order_summary(evaluated: DataFrame) -> DataFrame:
    """One row per series with its fitted order, and how many series have that order with which spread of AIC.

    Reads ``evaluated`` twice: pass a stored table.
    """
    by = ["arima_order", "differencing_order", "has_drift"]
    rows = evaluated.withColumnRenamed("non_seasonal_d", "differencing_order")
    groups = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("article_count"),
        F.round(F.avg("aic"), 2).alias("avg_aic"),
        F.round(F.min("aic"), 2).alias("min_aic"),
        F.round(F.max("aic"), 2).alias("max_aic"),
    )
    # Every series has an order; only the drift flag may be absent.
    own = groups.withColumnsRenamed({c: f"of_{c}" for c in by})
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"of_{c}")) for c in by])
    return rows.join(own, same).select(
        *by, "article_count", "avg_aic", "min_aic", "max_aic", F.col("ad_unit").alias("article"), F.round("aic", 2).alias("aic")
    )


def step_change_units(evaluated: DataFrame) -> DataFrame:
    return evaluated.where("has_step_changes").select("ad_unit").distinct()


def arima_order(evaluated: DataFrame, unit: str) -> DataFrame:
    return evaluated.where(F.col("ad_unit") == unit).select(
        "ad_unit",
        "arima_order",
        F.col("non_seasonal_d").alias("differencing"),
        "has_drift",
        F.round("aic", 2).alias("aic"),
        "has_holiday_effect",
        "has_step_changes",
    )
