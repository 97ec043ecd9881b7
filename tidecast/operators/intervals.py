"""Width of forecast intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidecast.config import INTERVAL_NARROW_PCT, INTERVAL_WIDE_PCT
from tidecast.functions import scalars as fn

_WIDTH = "forecast_upper", "forecast_lower"


def _with_width(forecasts: DataFrame, model: str) -> DataFrame:
    width = F.col("forecast_upper") - F.col("forecast_lower")
    return forecasts.where(F.col("model_name") == model).select(
        "ad_unit",
        "fold_name",
        "forecast_value",
        width.alias("width"),
        (fn.ratio(width, F.col("forecast_value")) * 100).alias("width_pct"),
    )


def ci_widths(
    forecasts: DataFrame, model: str, narrow: float = INTERVAL_NARROW_PCT, wide: float = INTERVAL_WIDE_PCT
) -> DataFrame:
    """Interval width per series and fold, flagged by its unrounded share of the forecast."""
    stats = (
        _with_width(forecasts, model)
        .groupBy("ad_unit", "fold_name")
        .agg(
            F.count(F.lit(1)).alias("forecast_days"),
            F.round(F.avg("forecast_value"), 0).alias("avg_forecast"),
            F.round(F.avg("width"), 0).alias("avg_ci_width"),
            F.round(F.min("width"), 0).alias("min_ci_width"),
            F.round(F.max("width"), 0).alias("max_ci_width"),
            F.avg("width_pct").alias("pct"),
        )
    )
    flag = F.when(F.col("pct") < narrow, F.lit("NARROW")).when(F.col("pct") > wide, F.lit("WIDE"))
    return (
        stats.withColumn("avg_ci_pct", F.round("pct", 1))
        .withColumn("ci_flag", flag.otherwise(F.lit("NORMAL")))
        .drop("pct")
    )


def ci_overall(forecasts: DataFrame, model: str) -> DataFrame:
    """Interval width per fold over all series. Mean and deviation are combined on the map side."""
    return (
        _with_width(forecasts, model)
        .groupBy("fold_name")
        .agg(
            F.count_distinct("ad_unit").alias("num_articles"),
            F.round(F.avg("width"), 0).alias("overall_avg_ci_width"),
            F.round(F.avg("width_pct"), 1).alias("overall_avg_ci_pct"),
            F.round(F.stddev("width_pct"), 1).alias("ci_pct_stddev"),
        )
    )


def ci_flag_summary(widths: DataFrame) -> DataFrame:
    """Count and share of each flag, absent flags included."""
    flags = ("NORMAL", "NARROW", "WIDE")
    counted = widths.agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(F.col("ci_flag") == f).alias(f) for f in flags],
    )
    entries = F.array(*[F.struct(F.lit(f).alias("ci_flag"), F.col(f).alias("n_rows")) for f in flags])
    return counted.select(F.explode(entries).alias("e"), "total").select(
        "e.ci_flag", "e.n_rows", F.round(fn.ratio(F.col("e.n_rows"), F.col("total")) * 100, 0).alias("share_pct")
    )


def top_flags(widths: DataFrame, flag: str, n: int = 10) -> DataFrame:
    """The ``n`` widest rows of one flag."""
    rows = widths.where(F.col("ci_flag") == flag)
    return rows.orderBy(F.desc("avg_ci_pct"), "ad_unit", "fold_name").limit(n)
