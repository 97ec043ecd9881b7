"""All models over all folds, scored, compared and priced."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidecast.config import CONFIDENCE_LEVEL, CPM, MODELS, REGRESSOR, STRUCTURAL, ZERO_SHOT, Fold, check_horizon
from tidecast.operators import metrics as m
from tidecast.operators import quality
from tidecast.operators.calendar import future_features
from tidecast.operators.folds import in_fold
from tidecast.operators.regression import fit_xreg, forecast_xreg
from tidecast.operators.seasonal import forecast_zero_shot
from tidecast.operators.structural import detect_anomalies, explain_forecast, fit_structural, forecast_structural
from tidecast.sources.tables import replace_table
from tidecast.sources.workspace import settle


@dataclass(frozen=True)
class WalkForward:
    """The tables of one run, named as they are stored.

    ``anomalies`` and ``decomposition`` are None without the structural model; ``metrics``, what follows from
    it and ``checks`` (fold_name, check, status) are None when not scored.
    """

    forecasts: DataFrame
    anomalies: DataFrame | None
    decomposition: DataFrame | None
    metrics: DataFrame | None = None
    comparison: DataFrame | None = None
    impact: DataFrame | None = None
    checks: DataFrame | None = None

    def store(self, root: str) -> None:
        """Replace the declared tables under ``root``."""
        tables = {
            "forecasts": self.forecasts,
            "anomalies": self.anomalies,
            "forecast_decomposition": self.decomposition,
            "model_metrics": self.metrics,
            "model_comparison": self.comparison,
            "business_impact": self.impact,
        }
        for name, frame in tables.items():
            if frame is not None:
                replace_table(frame, f"{root}/{name}", name)


def fold_features(daily: DataFrame, holidays: DataFrame, folds: list[Fold]) -> DataFrame:
    """Future features of every fold's test window."""
    first, last = min(f.test_start for f in folds), max(f.test_end for f in folds)
    return in_fold(future_features(daily, holidays, first, last), folds, "test")


def forecast_folds(
    daily: DataFrame,
    holidays: DataFrame,
    folds: list[Fold],
    models=MODELS,
    level: float = CONFIDENCE_LEVEL,
    params: DataFrame | None = None,
) -> DataFrame:
    """Forecasts of the chosen models for every fold. Folds are rows, so this is one plan.

    ``params`` are the fitted parameters of the structural model, where the caller has them.
    """
    horizon = folds[0].test_days
    check_horizon(folds, horizon)
    train = in_fold(daily, folds, "train")
    makers = {
        ZERO_SHOT: lambda: forecast_zero_shot(train, horizon, level),
        STRUCTURAL: lambda: forecast_structural(fit_structural(train, holidays) if params is None else params, holidays, horizon, level),
        REGRESSOR: lambda: forecast_xreg(fit_xreg(train), fold_features(daily, holidays, folds), level),
    }
    return reduce(DataFrame.unionByName, [makers[name]() for name in models])


def run_walk_forward(
    daily: DataFrame,
    holidays: DataFrame,
    folds: list[Fold],
    models=MODELS,
    level: float = CONFIDENCE_LEVEL,
    cpm: float = CPM,
) -> WalkForward:
    """Forecast, explain, flag anomalies, score, compare, price and check.

    The daily table, the structural parameters and the forecasts are read by several later branches, so
    each is written once to the shared folder instead of being worked out again per branch. A run of only
    some models gives forecasts without scores; one of a single fold has no comparison over folds.
    """
    daily = settle(daily, ["ad_unit", "date"])
    train = in_fold(daily, folds, "train")
    params = anomalies = parts = None
    if STRUCTURAL in models:
        params = settle(fit_structural(train, holidays))
        anomalies = detect_anomalies(train, holidays)
        parts = explain_forecast(params, holidays, folds[0].test_days, level)
    forecasts = settle(forecast_folds(daily, holidays, folds, models, level, params))
    if set(models) != set(MODELS):
        return WalkForward(forecasts, anomalies, parts)
    scored = settle(m.melt_metrics(m.forecast_metrics(forecasts, daily, folds), folds))
    comparison = m.compare_models(scored)
    if len(folds) > 1:
        comparison = comparison.unionByName(m.cross_fold(comparison))
    impact = m.business_impact(scored, daily, folds, cpm)
    return WalkForward(forecasts, anomalies, parts, scored, comparison, impact, run_checks(forecasts, scored, train, folds))


def run_checks(forecasts: DataFrame, metrics: DataFrame, train: DataFrame, folds: list[Fold], models: int = len(MODELS)) -> DataFrame:
    """Coverage, completeness and finiteness per fold: every series of its training rows, every model, every metric."""

    def of_fold(fold: str) -> DataFrame:
        units = train.where(F.col("fold_name") == fold).select(F.count_distinct("ad_unit")).scalar()
        results = [
            quality.check_forecast_coverage(forecasts, fold, models, units),
            quality.check_metrics_complete(metrics, fold, models, units),
            quality.check_finite(metrics, fold),
        ]
        rows = reduce(DataFrame.unionByName, [r.select("check", "status") for r in results])
        return rows.select(F.lit(fold).alias("fold_name"), "check", "status")

    return reduce(DataFrame.unionByName, [of_fold(f.name) for f in folds])
