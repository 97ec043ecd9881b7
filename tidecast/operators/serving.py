"""Reads behind the dashboards."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidecast.config import CROSS_FOLD, HIGHER_IS_BETTER, METRICS, MODELS, resolve_fold
from tidecast.functions.quantiles import exact_quantiles
from tidecast.operators.metrics import metric_only
from tidecast.sources.tables import date_filter


def get_actuals(daily: DataFrame, units: list[str], start=None, end=None) -> DataFrame:
    rows = date_filter(daily.where(F.col("ad_unit").isin(units)), start, end)
    return rows.select("date", "ad_unit", "daily_impressions").orderBy("ad_unit", "date")


def get_ad_units(daily: DataFrame) -> DataFrame:
    return daily.select("ad_unit").distinct().orderBy("ad_unit")


def get_forecasts(forecasts: DataFrame, units: list[str], models: list[str], fold: str) -> DataFrame:
    rows = forecasts.where(
        F.col("ad_unit").isin(units)
        & F.col("model_name").isin(models)
        & (F.col("fold_name") == resolve_fold(fold))
    )
    return rows.select(
        F.col("forecast_date").alias("date"),
        "ad_unit",
        "model_name",
        "forecast_value",
        F.col("forecast_lower").alias("lower_bound"),
        F.col("forecast_upper").alias("upper_bound"),
    ).orderBy("ad_unit", "model_name", "date")


def get_model_comparison(comparison: DataFrame, fold: str = CROSS_FOLD) -> DataFrame:
    rows = comparison.where(F.col("fold_name") == fold)
    return rows.select(
        "model_name",
        "metric_name",
        F.col("mean_value").alias("metric_value"),
        *[c for c in comparison.columns if c.endswith("_value") and c != "mean_value"],
    ).orderBy("model_name", "metric_name")


def get_metrics_detail(metrics: DataFrame, fold: str) -> DataFrame:
    rows = metrics.where(F.col("fold_name") == resolve_fold(fold))
    return rows.select("model_name", "ad_unit", "metric_name", "metric_value").orderBy(
        "model_name", "ad_unit", "metric_name"
    )


def get_business_impact(impact: DataFrame, fold: str) -> DataFrame:
    rows = impact.where(F.col("fold_name") == resolve_fold(fold)).drop("fold_name")
    return rows.orderBy(F.desc("annual_revenue_at_risk"))


def get_decomposition(decomposition: DataFrame, unit: str, fold: str) -> DataFrame:
    rows = decomposition.where((F.col("ad_unit") == unit) & (F.col("fold_name") == resolve_fold(fold)))
    return rows.select(
        F.col("forecast_date").alias("date"),
        "forecast_value",
        F.col("prediction_interval_lower_bound").alias("lower_bound"),
        F.col("prediction_interval_upper_bound").alias("upper_bound"),
        "trend",
        F.col("seasonal_period_weekly").alias("weekly"),
        F.col("seasonal_period_yearly").alias("yearly"),
        "holiday_effect",
        "spikes_and_dips",
        "step_changes",
        "residual",
    ).orderBy("date")


def clip_horizon(forecasts: DataFrame, days: int, date_col: str = "forecast_date") -> DataFrame:
    """Up to ``days`` after the first date of the selection, both ends included."""
    first = forecasts.select(F.min(date_col)).scalar()
    return forecasts.where(F.col(date_col) <= F.date_add(first, days))


# ---- pivots -------------------------------------------------------------------------------------


def metric_matrix(comparison: DataFrame, fold: str = CROSS_FOLD, metrics=METRICS) -> DataFrame:
    """One row per model, one column per metric, and whether it is the best in that metric."""
    wide = (
        comparison.where(F.col("fold_name") == fold)
        .groupBy("model_name")
        .agg(*[F.min(F.when(F.col("metric_name") == m, F.col("mean_value"))).alias(m) for m in metrics])
    )
    everyone = Window.partitionBy(F.lit(fold))  # one row per model
    best = {
        f"best_{m}": F.coalesce(
            F.col(m) == (F.max(m) if m in HIGHER_IS_BETTER else F.min(m)).over(everyone), F.lit(False)
        )
        for m in metrics
    }
    return wide.withColumns(best)


def mape_matrix(metrics: DataFrame, fold: str, models=MODELS) -> DataFrame:
    """MAPE per series and model, absent ones NULL, and the model with the least."""
    values = [F.max(F.when(F.col("model_name") == m, F.col("metric_value"))).alias(m) for m in models]
    wide = metric_only(metrics).where(F.col("fold_name") == fold).groupBy("ad_unit").agg(*values)
    # least() refuses a single column, and skips NULLs otherwise.
    least = F.least(*models) if len(models) > 1 else F.col(models[0])
    best = F.lit(None).cast("string")
    for m in reversed(models):
        best = F.when(F.col(m) == least, F.lit(m)).otherwise(best)
    return wide.withColumn("best_model", best)


def mape_box(metrics: DataFrame, fold: str) -> DataFrame:
    """Quartiles and whiskers of MAPE per model: whiskers end at the last point within 1.5 IQR."""
    rows = metric_only(metrics).where(F.col("fold_name") == fold).select("model_name", "ad_unit", "metric_value")
    fences = _fences(rows)
    inside = rows.join(fences, "model_name").groupBy(*fences.columns).agg(
        F.min(F.when(F.col("metric_value") >= F.col("fence_low"), F.col("metric_value"))).alias("whisker_low"),
        F.max(F.when(F.col("metric_value") <= F.col("fence_high"), F.col("metric_value"))).alias("whisker_high"),
        F.count_if(~F.col("metric_value").between(F.col("fence_low"), F.col("fence_high"))).alias("n_outliers"),
    )
    return inside.select("model_name", "n", "q1", "median", "q3", "whisker_low", "whisker_high", "n_outliers")


def mape_outliers(metrics: DataFrame, fold: str) -> DataFrame:
    """The series outside the whiskers, one row each."""
    rows = metric_only(metrics).where(F.col("fold_name") == fold).select("model_name", "ad_unit", "metric_value")
    outside = ~F.col("metric_value").between(F.col("fence_low"), F.col("fence_high"))
    return rows.join(_fences(rows), "model_name").where(outside).select(
        "model_name", "ad_unit", "metric_value"
    )


def _fences(rows: DataFrame) -> DataFrame:
    quartiles = exact_quantiles(rows, "metric_value", {"q1": 0.25, "median": 0.5, "q3": 0.75}, ["model_name"])
    spread = 1.5 * (F.col("q3") - F.col("q1"))
    return quartiles.withColumns({"fence_low": F.col("q1") - spread, "fence_high": F.col("q3") + spread})


def residual_histogram(residuals: DataFrame, low: float, high: float, bins: int) -> DataFrame:
    """Residuals per model in equal bins; bin 0 lies below ``low`` and ``bins + 1`` from ``high`` on."""
    width = (high - low) / bins
    inner = F.floor((F.col("residual") - low) / width).cast("bigint") + 1
    bin_no = F.least(F.greatest(inner, F.lit(0)), F.lit(bins + 1))
    return residuals.groupBy("model_name", bin_no.alias("bin")).agg(F.count(F.lit(1)).alias("n_residuals")).withColumn(
        "bin_start", F.when(F.col("bin") > 0, low + (F.col("bin") - 1) * width)
    )


def headline(comparison: DataFrame, metric: str = "mape", fold: str = CROSS_FOLD, models=MODELS) -> DataFrame:
    """One value per model, in the fixed order of the models."""
    position = F.array_position(F.array(*[F.lit(m) for m in models]), F.col("model_name"))
    rows = metric_only(comparison, metric).where(
        (F.col("fold_name") == fold) & F.col("model_name").isin(*models) & F.col("mean_value").isNotNull()
    )
    return rows.select(
        position.alias("position"), "model_name", F.col("mean_value").alias("metric_value")
    ).orderBy("position")
