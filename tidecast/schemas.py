"""Schemas of the stored tables, with their partition and sort columns."""

from __future__ import annotations

from pyspark.sql import types as T

_TYPES = {
    "D": T.DateType(),
    "S": T.StringType(),
    "I": T.LongType(),
    "F": T.DoubleType(),
    "B": T.BooleanType(),
    "TS": T.TimestampType(),
}


def schema(spec: str) -> T.StructType:
    """``"date D, holiday_name S?"`` -> StructType; ``?`` marks a nullable column."""
    fields = []
    for part in spec.split(","):
        name, kind = part.split()
        fields.append(T.StructField(name, _TYPES[kind.rstrip("?")], kind.endswith("?")))
    return T.StructType(fields)


_CALENDAR = (
    "day_of_week I, is_weekend B, quarter I, week_of_year I, "
    "is_holiday B, holiday_name S?, days_to_next_holiday I?"
)
_PARTS = (
    "trend F?, seasonal_period_weekly F?, seasonal_period_yearly F?, holiday_effect F?, "
    "spikes_and_dips F?, step_changes F?, residual F?"
)

SCHEMAS: dict[str, T.StructType] = {
    "hourly": schema("datehour TS, wiki S, title S, views I"),
    "raw_pageviews": schema(
        "date D, wiki S, ad_unit S, daily_impressions I, desktop_impressions I, mobile_impressions I"
    ),
    "us_holidays": schema("holiday_date D, holiday_name S, is_major B"),
    "daily_impressions": schema(
        "date D, ad_unit S, daily_impressions I, desktop_impressions I, mobile_impressions I, " + _CALENDAR
    ),
    "future_features": schema("date D, ad_unit S, " + _CALENDAR),
    "forecasts": schema(
        "forecast_date D, ad_unit S, model_name S, fold_name S, forecast_value F, "
        "forecast_lower F?, forecast_upper F?, confidence_level F?"
    ),
    # MASE has no value on a constant series, so the metric is nullable.
    "model_metrics": schema(
        "model_name S, fold_name S, ad_unit S, metric_name S, metric_value F?, test_start D, test_end D"
    ),
    "model_comparison": schema(
        "model_name S, fold_name S, metric_name S, mean_value F?, median_value F?, std_value F?, "
        "min_value F?, max_value F?"
    ),
    "business_impact": schema(
        "model_name S, fold_name S, ad_unit S, avg_daily_impressions F, mape F?, cpm F, "
        "daily_revenue_at_risk F?, annual_revenue_at_risk F?"
    ),
    "forecast_decomposition": schema(
        "forecast_date D, ad_unit S, fold_name S, forecast_value F?, prediction_interval_lower_bound F?, "
        "prediction_interval_upper_bound F?, " + _PARTS
    ),
    "anomalies": schema(
        "date D, ad_unit S, fold_name S, daily_impressions F, is_anomaly B, lower_bound F?, "
        "upper_bound F?, anomaly_probability F?"
    ),
}

# table -> (partition columns, sort columns inside a partition).
LAYOUT: dict[str, tuple[list[str], list[str]]] = {
    "raw_pageviews": (["date"], ["ad_unit"]),
    "us_holidays": ([], ["holiday_date"]),
    "daily_impressions": (["date"], ["ad_unit"]),
    "future_features": (["date"], ["ad_unit"]),
    "forecasts": (["fold_name", "model_name"], ["ad_unit", "forecast_date"]),
    "model_metrics": (["fold_name", "model_name"], ["ad_unit"]),
    "model_comparison": (["fold_name"], ["model_name"]),
    "business_impact": (["fold_name", "model_name"], ["ad_unit"]),
    "forecast_decomposition": (["fold_name"], ["ad_unit", "forecast_date"]),
    "anomalies": (["fold_name"], ["ad_unit", "is_anomaly"]),
}
