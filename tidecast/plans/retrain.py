"""Periodic retraining with a gate on accuracy."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidecast.config import HORIZON, RETRAIN_LOOKBACK_DAYS, RETRAIN_MAPE_GATE, Fold
from tidecast.operators.folds import in_fold
from tidecast.operators.metrics import forecast_vs_actual
from tidecast.operators.structural import fit_structural, forecast_structural
from tidecast.functions import scalars as fn
from tidecast.sources.tables import read_table, recent, replace_table
from tidecast.sources.workspace import settle


def holdout_fold(as_of: date, days: int, horizon: int) -> Fold:
    """The look-back window with its last ``horizon`` days held out."""
    test_start = as_of - timedelta(days=horizon - 1)
    return Fold("retrain", as_of - timedelta(days=days), test_start - timedelta(days=1), test_start, as_of)


def retrain(
    daily: DataFrame,
    holidays: DataFrame,
    as_of: date,
    days: int = RETRAIN_LOOKBACK_DAYS,
    gate: float = RETRAIN_MAPE_GATE,
    horizon: int = HORIZON,
) -> DataFrame:
    """One verdict row: mean MAPE of the series on the held-out days, PROMOTED or REJECTED.

    Publish the parameters only on PROMOTED, so that a rejected model replaces nothing.
    """
    fold = holdout_fold(as_of, days, horizon)
    staged = recent(daily, days, as_of)
    params = fit_structural(in_fold(staged, [fold], "train"), holidays)
    scored = forecast_vs_actual(forecast_structural(params, holidays, horizon), staged, [fold])
    error = fn.ratio(F.abs(F.col("forecast_value") - F.col("actual")), F.col("actual"))
    judged = scored.groupBy("ad_unit").agg(F.avg(error).alias("mape")).agg(
        F.count("mape").alias("n_series"), F.avg("mape").alias("mape")
    )
    return judged.select(
        "n_series",
        "mape",
        F.lit(float(gate)).alias("gate"),
        F.when(F.col("mape") <= gate, F.lit("PROMOTED")).otherwise(F.lit("REJECTED")).alias("status"),
    )


def staged_parameters(
    daily: DataFrame, holidays: DataFrame, as_of: date, days: int = RETRAIN_LOOKBACK_DAYS
) -> DataFrame:
    """Parameters fitted on the whole look-back window, for publishing after a PROMOTED verdict."""
    fold = Fold("retrain", as_of - timedelta(days=days), as_of, as_of, as_of)
    return fit_structural(in_fold(recent(daily, days, as_of), [fold], "train"), holidays)


def retrain_and_publish(
    daily: DataFrame,
    holidays: DataFrame,
    as_of: date,
    root: str,
    days: int = RETRAIN_LOOKBACK_DAYS,
    gate: float = RETRAIN_MAPE_GATE,
    horizon: int = HORIZON,
) -> DataFrame:
    """Stage new parameters, judge them and publish them only on PROMOTED. Returns the verdict row.

    The look-back window is stored as ``root/staging/daily_impressions`` and its parameters as
    ``root/staging/model_parameters``; only a PROMOTED run replaces ``root/model_parameters``, so a rejected
    or interrupted one leaves the published parameters as they were.
    """
    spark, staging = daily.sparkSession, f"{root}/staging"
    replace_table(recent(daily, days, as_of), f"{staging}/daily_impressions", "daily_impressions", [])
    window = read_table(spark, f"{staging}/daily_impressions", "daily_impressions")
    verdict = settle(retrain(window, holidays, as_of, days, gate, horizon))
    replace_table(staged_parameters(window, holidays, as_of, days), f"{staging}/model_parameters")
    if verdict.first()["status"] == "PROMOTED":
        replace_table(read_table(spark, f"{staging}/model_parameters"), f"{root}/model_parameters")
    return verdict
