"""Training-free seasonal forecaster: the model for series with little or erratic history."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidecast.config import CONFIDENCE_LEVEL, HORIZON, ZERO_SHOT
from tidecast.functions import scalars as fn

KEYS = ["fold_name", "ad_unit"]
SEASON = 7


def forecast_rows(
    df: DataFrame, model: str, level: float, value, half_width, keys=KEYS
) -> DataFrame:
    """The stored forecast columns, from a value and the half-width of its interval."""
    return df.select(
        "forecast_date",
        "ad_unit",
        F.lit(model).alias("model_name"),
        *[k for k in keys if k != "ad_unit"],
        value.alias("forecast_value"),
        (value - half_width).alias("forecast_lower"),
        (value + half_width).alias("forecast_upper"),
        F.lit(float(level)).alias("confidence_level"),
    )


def forecast_zero_shot(
    train: DataFrame, horizon: int = HORIZON, level: float = CONFIDENCE_LEVEL, recent: int = 4, keys=KEYS
) -> DataFrame:
    """Mean of the last ``recent`` values of the same weekday, ``horizon`` days past each series.

    The interval widens by whole seasons with the spread of the 7-row differences in training.
    One shuffle by series: two windows, one aggregation to a row per series, then a generator.
    """
    y = F.col("daily_impressions")
    by_day = Window.partitionBy(*keys, "dow").orderBy(F.col("date").desc())
    in_time = Window.partitionBy(*keys).orderBy("date")
    ranked = train.select(*keys, "date", "daily_impressions", F.dayofweek("date").alias("dow")).select(
        "*",
        (y - F.lag(y, SEASON).over(in_time)).alias("season_error"),
        F.row_number().over(by_day).alias("age"),
    )
    per_day = [F.avg(F.when((F.col("dow") == d) & (F.col("age") <= recent), y)) for d in range(1, 8)]
    fitted = ranked.groupBy(*keys).agg(
        F.max("date").alias("last_date"),
        F.avg(y).alias("overall"),
        F.stddev("season_error").alias("sigma"),
        F.array(*per_day).alias("weekday_level"),
    )
    steps = fitted.select("*", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("h")).withColumn(
        "forecast_date", F.date_add("last_date", F.col("h"))
    )
    value = F.coalesce(F.element_at("weekday_level", F.dayofweek("forecast_date")), F.col("overall"))
    seasons = F.sqrt(1.0 + F.floor((F.col("h") - 1) / SEASON))
    return forecast_rows(steps, ZERO_SHOT, level, value, fn.z_score(level) * F.col("sigma") * seasons, keys)
