"""Scoring forecasts, comparing models and pricing the error."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidecast.config import CPM, CROSS_FOLD, CV_EVENT_DRIVEN, HIGH_RISK_ANNUAL, METRICS, Fold
from tidecast.functions import scalars as fn
from tidecast.operators.folds import in_fold, with_fold_dates

SERIES_FOLD = ["fold_name", "ad_unit"]
SCORED = ["model_name", "fold_name", "ad_unit"]


def forecast_vs_actual(forecasts: DataFrame, daily: DataFrame, folds: list[Fold]) -> DataFrame:
    """Each forecast with the actual of its day, inside the fold's test window."""
    actuals = in_fold(
        daily.select(F.col("date").alias("forecast_date"), "ad_unit", F.col("daily_impressions").alias("actual")),
        folds,
        "test",
        "forecast_date",
    )
    return forecasts.join(actuals, ["fold_name", "ad_unit", "forecast_date"])


def residuals(forecasts: DataFrame, daily: DataFrame, fold: str) -> DataFrame:
    """Forecast minus actual; positive means over-forecast."""
    actuals = daily.select(F.col("date").alias("forecast_date"), "ad_unit", "daily_impressions")
    return (
        forecasts.where(F.col("fold_name") == fold)
        .join(actuals, ["ad_unit", "forecast_date"])
        .select(
            "model_name",
            "ad_unit",
            F.col("forecast_date").alias("date"),
            (F.col("forecast_value") - F.col("daily_impressions")).alias("residual"),
        )
    )


def naive_error(daily: DataFrame, folds: list[Fold]) -> DataFrame:
    """Mean absolute day-to-day change in training, per fold and series."""
    previous = F.lag("daily_impressions").over(Window.partitionBy(*SERIES_FOLD).orderBy("date"))
    train = in_fold(daily.select("date", "ad_unit", "daily_impressions"), folds, "train")
    return (
        train.withColumn("previous", previous)
        .where(F.col("previous").isNotNull())
        .groupBy(*SERIES_FOLD)
        .agg(F.avg(F.abs(F.col("daily_impressions") - F.col("previous"))).alias("naive_error"))
    )


def forecast_metrics(forecasts: DataFrame, daily: DataFrame, folds: list[Fold]) -> DataFrame:
    """MAPE, RMSE, MAE, MASE and coverage, one row per model, fold and series."""
    error = F.col("forecast_value") - F.col("actual")
    covered = F.col("actual").between(F.col("forecast_lower"), F.col("forecast_upper"))
    scores = (
        forecast_vs_actual(forecasts, daily, folds)
        .groupBy(*SCORED)
        .agg(
            # Days without traffic have no percentage error and drop out of the mean.
            (F.avg(fn.ratio(F.abs(error), F.col("actual"))) * 100).alias("mape"),
            F.sqrt(F.avg(error * error)).alias("rmse"),
            F.avg(F.abs(error)).alias("mae"),
            # A missing bound covers nothing.
            (F.avg(F.when(covered, 1.0).otherwise(0.0)) * 100).alias("coverage"),
        )
    )
    return scores.join(naive_error(daily, folds), SERIES_FOLD, "left").select(
        *SCORED, "mape", "rmse", "mae", fn.ratio(F.col("mae"), F.col("naive_error")).alias("mase"), "coverage"
    )


def melt_metrics(wide: DataFrame, folds: list[Fold]) -> DataFrame:
    """One row per metric, NULLs kept, with the fold's test window."""
    long = wide.unpivot(SCORED, list(METRICS), "metric_name", "metric_value")
    return with_fold_dates(long, folds, "test_start", "test_end")


def metric_only(metrics: DataFrame, metric: str = "mape") -> DataFrame:
    return metrics.where(F.col("metric_name") == metric)


def compare_models(metrics: DataFrame) -> DataFrame:
    """Spread of each metric over the series, per model and fold. NULLs are left out."""
    v = F.col("metric_value")
    return metrics.groupBy("model_name", "fold_name", "metric_name").agg(
        F.avg(v).alias("mean_value"),
        F.percentile_approx(v, 0.5, 10_000).alias("median_value"),
        F.stddev(v).alias("std_value"),
        F.min(v).alias("min_value"),
        F.max(v).alias("max_value"),
    )


def cross_fold(comparison: DataFrame) -> DataFrame:
    """The mean of the folds, as one more fold."""
    return (
        comparison.where(F.col("fold_name") != CROSS_FOLD)
        .groupBy("model_name", "metric_name")
        .agg(
            F.lit(CROSS_FOLD).alias("fold_name"),
            *[F.avg(c).alias(c) for c in ("mean_value", "median_value", "std_value")],
            F.min("min_value").alias("min_value"),
            F.max("max_value").alias("max_value"),
        )
        .select(*comparison.columns)
    )


def business_impact(metrics: DataFrame, daily: DataFrame, folds: list[Fold], cpm: float = CPM) -> DataFrame:
    """Revenue at risk: mean daily volume in thousands, times price, times percentage error."""
    traffic = (
        in_fold(daily.select("date", "ad_unit", "daily_impressions"), folds, "train")
        .groupBy(*SERIES_FOLD)
        .agg(F.avg("daily_impressions").alias("avg_daily_impressions"))
    )
    mape = metric_only(metrics).select(*SCORED, F.col("metric_value").alias("mape"))
    at_risk = F.col("avg_daily_impressions") / 1000.0 * cpm * (F.col("mape") / 100.0)
    return mape.join(traffic, SERIES_FOLD).select(
        *SCORED,
        "avg_daily_impressions",
        "mape",
        F.lit(float(cpm)).alias("cpm"),
        at_risk.alias("daily_revenue_at_risk"),
        (at_risk * 365.0).alias("annual_revenue_at_risk"),
    )


def summed_impact(impact: DataFrame) -> DataFrame:
    """Risk per model, added up over series and folds (a sum over folds, not a mean)."""
    return (
        impact.where(F.col("fold_name") != CROSS_FOLD)
        .groupBy("model_name")
        .agg(
            F.sum("daily_revenue_at_risk").alias("total_daily_risk"),
            F.sum("annual_revenue_at_risk").alias("total_annual_risk"),
        )
    )


def model_ranking(comparison: DataFrame, impact: DataFrame) -> DataFrame:
    """Models ranked by mean MAPE over the folds, with RMSE, coverage and summed risk."""
    average = comparison.where(F.col("fold_name") == CROSS_FOLD)

    def pick(metric, column):
        return F.max(F.when(F.col("metric_name") == metric, F.col(column)))

    wide = (
        average.groupBy("model_name")
        .agg(
            pick("mape", "mean_value").alias("mean_mape"),
            pick("mape", "median_value").alias("median_mape"),
            pick("rmse", "mean_value").alias("mean_rmse"),
            pick("coverage", "mean_value").alias("mean_coverage"),
            F.max(F.col("metric_name") == "mape").alias("has_mape"),
        )
        .where("has_mape")
    )
    # One row per model: a rank over all of them is a handful of rows.
    ranked = wide.withColumn("rank", F.rank().over(Window.orderBy(F.col("mean_mape").asc_nulls_first())))
    return ranked.join(summed_impact(impact), "model_name", "left").select(
        F.col("rank").cast("bigint").alias("rank"),
        "model_name",
        F.round("mean_mape", 2).alias("mean_mape_pct"),
        F.round("median_mape", 2).alias("median_mape_pct"),
        F.round("mean_rmse", 0).alias("mean_rmse"),
        F.round("mean_coverage", 1).alias("coverage_95_pct"),
        F.round("total_daily_risk", 2).alias("daily_revenue_at_risk_usd"),
        F.round("total_annual_risk", 0).alias("annual_revenue_at_risk_usd"),
    )


def impact_summary(
    impact: DataFrame, model: str, baseline: str, cut: float = HIGH_RISK_ANNUAL
) -> DataFrame:
    """Headline row: risk of two models, saving per million daily impressions, total, largest, count."""

    def total(name, column):
        return F.sum(F.when(F.col("model_name") == name, F.col(column)))

    risk = "annual_revenue_at_risk"
    totals = impact.agg(
        total(model, risk).alias("model_risk"),
        total(baseline, risk).alias("baseline_risk"),
        total(model, "avg_daily_impressions").alias("model_impressions"),
        F.sum(risk).alias("total_annual_risk"),
        F.max(risk).alias("max_annual_risk"),
        F.count_if(F.col(risk) > cut).alias("high_risk_count"),
    )
    saving = F.when(
        F.col("model_impressions") > 0,
        (F.col("baseline_risk") - F.col("model_risk")) / F.col("model_impressions") * 1_000_000.0,
    )
    return totals.withColumn("savings_per_million", saving)


def volatility(daily: DataFrame) -> DataFrame:
    """Coefficient of variation per series."""
    return daily.groupBy("ad_unit").agg(
        fn.ratio(F.stddev("daily_impressions"), F.avg("daily_impressions")).alias("cv")
    )


def filter_content_type(df: DataFrame, cv: DataFrame, kind: str) -> DataFrame:
    """Rows of stable (cv below 0.5) or event-driven series; ``all`` keeps everything."""
    if kind == "all":
        return df
    classes = {"stable": F.col("cv") < CV_EVENT_DRIVEN, "event_driven": F.col("cv") >= CV_EVENT_DRIVEN}
    if kind not in classes:
        raise ValueError(f"kind must be all, stable or event_driven, not {kind!r}")
    return df.join(cv.where(classes[kind]).select("ad_unit"), "ad_unit", "left_semi")
