"""Classifying series by volatility and routing each to a model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidecast.config import (
    COLD_START_DAYS,
    CV_EVENT_DRIVEN,
    CV_REGRESSOR_MAX,
    REGRESSOR,
    STRUCTURAL,
    ZERO_SHOT,
)
from tidecast.functions import scalars as fn


def classify_volatility(cv: DataFrame) -> DataFrame:
    """Two-way class, three-way tier and the strict high-volatility warning, from ``cv``."""
    v = F.col("cv")
    return cv.withColumns(
        {
            "content_type": F.when(v >= CV_EVENT_DRIVEN, F.lit("event_driven")).when(
                v < CV_EVENT_DRIVEN, F.lit("stable")
            ),
            "volatility_tier": F.when(v < CV_REGRESSOR_MAX, F.lit("regressor_eligible"))
            .when(v < CV_EVENT_DRIVEN, F.lit("moderate"))
            .when(v >= CV_EVENT_DRIVEN, F.lit("event_driven")),
            "high_volatility": F.coalesce(v > CV_EVENT_DRIVEN, F.lit(False)),
        }
    )


def route_models(daily: DataFrame, need_explain: bool = False) -> DataFrame:
    """The model of each series: short or erratic history needs no training, the rest is fitted."""
    history = daily.groupBy("ad_unit").agg(
        F.count(F.lit(1)).alias("history_days"),
        fn.ratio(F.stddev("daily_impressions"), F.avg("daily_impressions")).alias("cv"),
    )
    model = (
        F.when(F.col("history_days") < COLD_START_DAYS, F.lit(ZERO_SHOT))
        .when(F.lit(need_explain), F.lit(STRUCTURAL))
        .when(F.coalesce(F.col("cv"), F.lit(0.0)) >= CV_EVENT_DRIVEN, F.lit(ZERO_SHOT))
        .otherwise(F.lit(REGRESSOR))
    )
    return history.withColumn("model_name", model)
