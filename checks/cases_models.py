"""Models, metrics, comparison, routing and walk-forward runs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from checks.bindings import END, FOLDS, Bound
from checks.registry import case, rounded
from checks.sql_library import LIBRARY, r
from tidecast.config import MODELS, STRUCTURAL, ZERO_SHOT
from tidecast.operators import metrics as m
from tidecast.operators import structural as st
from tidecast.operators.folds import in_fold
from tidecast.operators.moving_average import fit_moving_average
from tidecast.operators.orders import MAX_P, fit_orders, remainder_forecast
from tidecast.operators.regression import fit_xreg, forecast_with, forecast_xreg
from tidecast.operators.regression_ar import fit_xreg_ar, forecast_xreg_ar
from tidecast.operators.routing import classify_volatility, route_models
from tidecast.operators.seasonal import forecast_zero_shot
from tidecast.operators.seasons import season_table
from tidecast.plans.retrain import retrain
from tidecast.plans.walk_forward import fold_features, run_walk_forward

_FC = ", ".join(
    ["forecast_date", "ad_unit", "model_name", "fold_name"]
    + [f"{r(c, 4)} AS {c}" for c in ("forecast_value", "forecast_lower", "forecast_upper")]
    + ["0.95::DOUBLE AS confidence_level"]
)


def _forecast(df):
    return rounded(df, 4, "forecast_value", "forecast_lower", "forecast_upper")


@case(f"SELECT {_FC} FROM x_zero_wide")
def forecast_zero_shot_wide(b: Bound):
    return _forecast(forecast_zero_shot(in_fold(b.daily_wide, FOLDS, "train")))


@case(
    f"""SELECT fold_name, ad_unit, last_date, n, {r('intercept', 4)} AS intercept, {r('sigma', 4)} AS sigma,
    {r('c1', 4)} AS c1, {r('c2', 4)} AS c2, {r('c3', 4)} AS c3, {r('c4', 4)} AS c4 FROM x_reg_wide"""
)
def fit_regression(b: Bound):
    fitted = fit_xreg(in_fold(b.daily_wide, FOLDS, "train"))
    flat = fitted.select("*", *[F.element_at("coefficients", i).alias(f"c{i}") for i in range(1, 5)])
    return rounded(flat.drop("coefficients"), 4, "intercept", "sigma", "c1", "c2", "c3", "c4")


@case(f"SELECT {_FC} FROM x_xreg_wide")
def forecast_regression(b: Bound):
    daily = b.daily_wide_kept
    features = fold_features(daily, b.holidays, FOLDS)
    return _forecast(forecast_xreg(fit_xreg(in_fold(daily, FOLDS, "train")), features))


@case(
    f"""SELECT fold_name, ad_unit, last_date, n, {r('intercept', 4)} AS intercept, {r('sigma', 4)} AS sigma, {r('phi', 6)} AS phi,
    {r('last_e', 4)} AS last_e, {r('c1', 4)} AS c1, {r('c2', 4)} AS c2, {r('c3', 4)} AS c3, {r('c4', 4)} AS c4 FROM x_ar"""
)
def fit_regression_with_ar(b: Bound):
    fitted = fit_xreg_ar(in_fold(b.daily_wide, FOLDS, "train"))
    flat = fitted.select("*", *[F.element_at("coefficients", i).alias(f"c{i}") for i in range(1, 5)]).drop("coefficients")
    return rounded(rounded(flat, 4, "intercept", "sigma", "last_e", "c1", "c2", "c3", "c4"), 6, "phi")


@case(f"SELECT {_FC} FROM x_ar_fc")
def forecast_regression_with_ar(b: Bound):
    daily = b.daily_wide_kept
    features = fold_features(daily, b.holidays, FOLDS)
    return _forecast(forecast_xreg_ar(fit_xreg_ar(in_fold(daily, FOLDS, "train")), features))


_HISTORY = ("spike", "level", "trend", "weekly", "yearly", "holiday", "e")


@case(
    f"""SELECT fold_name, ad_unit, date, y, step <> 0 AS is_step, {r('y - c', 4)} AS spike, {r('level', 4)} AS level,
    {r('icpt + slope * t', 4)} AS trend, {r('weekly', 4)} AS weekly, {r('yearly', 4)} AS yearly, {r('heff', 4)} AS holiday,
    {r('e', 4)} AS e FROM x_st_lag"""
)
def decompose_history(b: Bound):
    parts = st.decompose_history(b.train, b.holidays)
    return rounded(parts.select("fold_name", "ad_unit", "date", "y", "is_step", *_HISTORY), 4, *_HISTORY)


@case(
    f"""SELECT fold_name, ad_unit, t0, last_date, n_days, p, d, has_drift, has_yearly, has_holiday AS has_holiday_effect,
    has_spikes AS has_spikes_and_dips, has_steps AS has_step_changes, {r('slope', 6)} AS slope, {r('icpt', 4)} AS intercept,
    {r('level', 4)} AS level, {r('phi', 6)} AS phi, {r('mu', 4)} AS mu, {r('last_e', 4)} AS last_e, {r('last_de', 4)} AS last_de,
    {r('variance', 3)} AS variance, {r('aic', 3)} AS aic, {r('-0.5 * n * (ln(2 * pi() * variance) + 1)', 3)} AS log_likelihood
    FROM x_sw_fit"""
)
def fit_structural(b: Bound):
    fitted = st.fit_structural(in_fold(b.daily_wide, FOLDS, "train"), b.holidays)
    fitted = fitted.drop("weekly", "yearly", "holiday_effects")
    fitted = rounded(fitted, 6, "slope", "phi")
    fitted = rounded(fitted, 4, "intercept", "level", "mu", "last_e", "last_de")
    return rounded(fitted, 3, "variance", "aic", "log_likelihood")


@case(f"SELECT {_FC} FROM x_sw_fc")
def forecast_structural(b: Bound):
    params = st.fit_structural(in_fold(b.daily_wide, FOLDS, "train"), b.holidays)
    return _forecast(st.forecast_structural(params, b.holidays))


_PARTS = {
    "forecast_value": "fv", "prediction_interval_lower_bound": "fv - half", "prediction_interval_upper_bound": "fv + half",
    "trend": "trend", "seasonal_period_weekly": "weekly", "seasonal_period_yearly": "yearly", "holiday_effect": "heff",
    "spikes_and_dips": "0.0::DOUBLE", "step_changes": "level", "residual": "ar",
}


_DECOMPOSED = "SELECT forecast_date, ad_unit, fold_name, " + ", ".join(f"{r(e, 4)} AS {c}" for c, e in _PARTS.items()) + " FROM x_st_dec"


@case(_DECOMPOSED)
def explain_forecast(b: Bound):
    return rounded(b.decomposition, 4, *_PARTS)


_ANOMALIES = f"""SELECT date, ad_unit, fold_name, daily_impressions, is_anomaly, {r('lower_bound', 4)} AS lower_bound,
    {r('upper_bound', 4)} AS upper_bound, {r('anomaly_probability', 6)} AS anomaly_probability FROM x_st_anom"""


@case(_ANOMALIES)
def detect_anomalies(b: Bound):
    return rounded(rounded(b.anomalies, 4, "lower_bound", "upper_bound"), 6, "anomaly_probability")


@case(
    f"""SELECT fold_name, ad_unit, p AS non_seasonal_p, d AS non_seasonal_d, 0::BIGINT AS non_seasonal_q,
    'ARIMA(' || p || ',' || d || ',0)' AS arima_order, has_drift, {r('-0.5 * n * (ln(2 * pi() * variance) + 1)', 3)} AS log_likelihood,
    {r('aic', 3)} AS aic, {r('variance', 3)} AS variance, CASE WHEN has_yearly THEN 'WEEKLY,YEARLY' ELSE 'WEEKLY' END AS seasonal_periods,
    has_holiday AS has_holiday_effect, has_spikes AS has_spikes_and_dips, has_steps AS has_step_changes FROM x_st_fit"""
)
def evaluate_orders(b: Bound):
    out = b.evaluated.withColumn("seasonal_periods", F.array_join("seasonal_periods", ","))
    return rounded(out, 3, "log_likelihood", "aic", "variance")


@case(
    f"""SELECT fold_name, ad_unit, CASE WHEN p = 1 THEN {r('phi', 6)} END AS ar_1, p AS n_ar, 0::BIGINT AS n_ma,
    {r('mu', 4)} AS intercept_or_drift FROM x_st_fit"""
)
def arima_coefficients(b: Bound):
    c = st.coefficients(b.params)
    return c.select(
        "fold_name",
        "ad_unit",
        F.round(F.get("ar_coefficients", F.lit(0)), 6).alias("ar_1"),
        F.size("ar_coefficients").cast("bigint").alias("n_ar"),
        F.size("ma_coefficients").cast("bigint").alias("n_ma"),
        F.round("intercept_or_drift", 4).alias("intercept_or_drift"),
    )


@case(
    f"""SELECT fold_name, ad_unit, p::BIGINT AS non_seasonal_p, d::BIGINT AS non_seasonal_d, q::BIGINT AS non_seasonal_q,
    'ARIMA(' || p || ',' || d || ',' || q || ')' AS arima_order, CASE WHEN p = 1 THEN {r('phi', 6)} END AS ar_1, CASE WHEN q = 1 THEN {r('theta', 6)} END AS ma_1,
    {r('mean', 4)} AS intercept_or_drift, {r('variance', 3)} AS variance, {r('aic', 3)} AS aic,
    CASE WHEN aic IS NOT NULL THEN {r('-0.5 * n * (ln(2 * pi() * variance) + 1)', 3)} END AS log_likelihood FROM x_sw_ma"""
)
def arima_moving_average(b: Bound):
    fitted = fit_moving_average(in_fold(b.daily_wide, FOLDS, "train"), b.holidays)
    terms = {"ar_1": F.round(F.get("ar_coefficients", F.lit(0)), 6), "ma_1": F.round(F.get("ma_coefficients", F.lit(0)), 6)}
    out = fitted.withColumns(terms).drop("ar_coefficients", "ma_coefficients")
    return rounded(rounded(out, 3, "variance", "aic", "log_likelihood"), 4, "intercept_or_drift")


@case(
    f"""SELECT fold_name, ad_unit, p::BIGINT AS non_seasonal_p, d::BIGINT AS non_seasonal_d, 0::BIGINT AS non_seasonal_q, 'ARIMA(' || p || ',' || d || ',0)' AS arima_order,
    {', '.join(f"{r(f'phi[{k}]', 6)} AS ar_{k}" for k in range(1, MAX_P + 1))}, {r('kpss_0', 6)} AS kpss_0, {r('kpss_1', 6)} AS kpss_1,
    {r('mu', 4)} AS intercept_or_drift, {r('variance', 3)} AS variance, {r('aic', 3)} AS aic, n_days,
    {r('-0.5 * n * (ln(2 * pi() * variance) + 1)', 3)} AS log_likelihood FROM x_ord"""
)
def arima_orders(b: Bound):
    found = fit_orders(in_fold(b.daily_wide, FOLDS, "train"), b.holidays)
    terms = {f"ar_{k}": F.round(F.get("ar_coefficients", F.lit(k - 1)), 6) for k in range(1, MAX_P + 1)}
    out = found.withColumns(terms).drop("ar_coefficients", "last_e")
    return rounded(rounded(rounded(out, 3, "variance", "aic", "log_likelihood"), 4, "intercept_or_drift"), 6, "kpss_0", "kpss_1")


@case(f"SELECT fold_name, ad_unit, h::BIGINT AS h, {r('remainder', 3)} AS remainder, {r('variance', 1)} AS variance FROM x_ord_fc")
def forecast_remainder(b: Bound):
    found = fit_orders(in_fold(b.daily_wide, FOLDS, "train"), b.holidays)
    return rounded(rounded(remainder_forecast(found), 3, "remainder"), 1, "variance")


@case(
    f"""SELECT fold_name, ad_unit, x_sea_n.n, {r('max(r) FILTER (q.k = 7)', 6)} AS r_7, {r('max(r) FILTER (q.k = 30)', 6)} AS r_30,
    coalesce((SELECT string_agg(s.k, ',' ORDER BY s.k) FROM x_sea s WHERE s.fold_name = x_sea_n.fold_name AND s.ad_unit = x_sea_n.ad_unit), '') AS periods
    FROM x_sea_n LEFT JOIN x_sea_r q USING (fold_name, ad_unit) GROUP BY ALL"""
)
def seasons_of_series(b: Bound):
    found = season_table(in_fold(b.daily_wide, FOLDS, "train"))
    strengths = {f"r_{k}": F.round(F.get("r", F.lit(k - 1)), 6) for k in (7, 30)}
    periods = F.coalesce(F.array_join(F.col("periods").cast("array<string>"), ","), F.lit(""))
    return found.withColumns(strengths).select("fold_name", "ad_unit", "n", *strengths, periods.alias("periods"))


@case(
    """SELECT u.fold_name, u.ad_unit, u.last_date + h::INTEGER AS forecast_date, u.v::DOUBLE AS forecast_value FROM
    (SELECT fold_name, ad_unit, max(date) AS last_date, arg_max(daily_impressions, date) AS v FROM x_train_wide GROUP BY ALL) u,
    range(1, 93) q(h)"""
)
def forecast_with_own_model(b: Bound):
    def last_value(series: pd.DataFrame) -> pd.DataFrame:
        last = series.loc[series["date"].idxmax()]
        days = pd.date_range(last["date"], periods=93, freq="D")[1:]
        return pd.DataFrame(
            {
                "fold_name": last["fold_name"],
                "ad_unit": last["ad_unit"],
                "forecast_date": days.date,
                "forecast_value": float(last["daily_impressions"]),
            }
        )

    train = in_fold(b.daily_wide, FOLDS, "train").select("fold_name", "ad_unit", "date", "daily_impressions")
    schema = "fold_name string, ad_unit string, forecast_date date, forecast_value double"
    return forecast_with(train.withColumn("date", F.col("date").cast("timestamp_ntz")), last_value, schema)


_RETRAINED = f"""SELECT count(*) AS n_series, {r('avg(v)', 6)} AS mape, {{0}}::DOUBLE AS gate, CASE WHEN avg(v) <= {{0}} THEN 'PROMOTED' ELSE 'REJECTED' END AS status
    FROM (SELECT z.ad_unit, avg(abs(z.forecast_value - d.daily_impressions) / nullif(d.daily_impressions, 0)) AS v
    FROM x_rt_fc z JOIN x_daily d ON d.ad_unit = z.ad_unit AND d.date = z.forecast_date
    WHERE d.date BETWEEN DATE '2001-11-04' - 91 AND DATE '2001-11-04' GROUP BY z.ad_unit)"""


@case(_RETRAINED.format("0.2"))
def retrain_verdict(b: Bound):
    return rounded(retrain(b.daily_kept, b.holidays, END), 6, "mape")


# ---- scoring ------------------------------------------------------------------------------------


@case(
    f"""SELECT c.model_name, c.fold_name, c.ad_unit, c.forecast_date, {r('c.forecast_value', 4)} AS forecast_value,
    d.daily_impressions AS actual FROM x_fc c JOIN x_daily d ON d.ad_unit = c.ad_unit AND d.date = c.forecast_date"""
)
def forecast_vs_actual(b: Bound):
    pairs = m.forecast_vs_actual(b.forecasts, b.daily_kept, FOLDS)
    return rounded(
        pairs.select("model_name", "fold_name", "ad_unit", "forecast_date", "forecast_value", "actual"), 4, "forecast_value"
    )


@case(
    f"""SELECT c.model_name, c.ad_unit, c.forecast_date AS date, {r('c.forecast_value - d.daily_impressions', 4)} AS residual
    FROM x_fc c JOIN x_daily d ON d.ad_unit = c.ad_unit AND d.date = c.forecast_date WHERE c.fold_name = 'fold_2'"""
)
def residuals(b: Bound):
    return rounded(m.residuals(b.forecasts, b.daily_kept, "fold_2"), 4, "residual")


@case(
    f"""SELECT fold_name, ad_unit, {r('avg(abs(x))', 6)} AS naive_error FROM (SELECT fold_name, ad_unit, daily_impressions
    - lag(daily_impressions) OVER (PARTITION BY fold_name, ad_unit ORDER BY date) AS x FROM x_train_wide) GROUP BY ALL"""
)
def naive_error(b: Bound):
    return rounded(m.naive_error(b.daily_wide, FOLDS), 6, "naive_error")


_WIDE = ("mape", "rmse", "mae", "mase", "coverage")


@case("SELECT model_name, fold_name, ad_unit, " + ", ".join(f"{r(c, 4)} AS {c}" for c in _WIDE) + " FROM x_scores_wide")
def forecast_metrics(b: Bound):
    return rounded(m.forecast_metrics(b.forecasts_wide, b.daily_wide_kept, FOLDS), 4, *_WIDE)


@case(
    f"SELECT model_name, fold_name, ad_unit, metric_name, {r('metric_value', 4)} AS metric_value, test_start, test_end FROM x_metrics"
)
def melt_metrics(b: Bound):
    return rounded(b.metrics, 4, "metric_value")


@case(f"SELECT model_name, fold_name, ad_unit, {r('metric_value', 4)} AS mape FROM x_metrics WHERE metric_name = 'mape'")
def metric_only(b: Bound):
    kept = m.metric_only(b.metrics, "mape")
    return kept.select("model_name", "fold_name", "ad_unit", F.round("metric_value", 4).alias("mape"))


_STATS = ("mean_value", "median_value", "std_value", "min_value", "max_value")
_CMP = "model_name, fold_name, metric_name, " + ", ".join(f"{r(c, 4)} AS {c}" for c in _STATS)


@case(f"SELECT {_CMP} FROM x_cmp WHERE fold_name <> 'cross_fold_avg'")
def compare_models(b: Bound):
    return rounded(m.compare_models(b.metrics_wide), 4, *_STATS)


@case(f"SELECT {_CMP} FROM x_cmp WHERE fold_name = 'cross_fold_avg'")
def cross_fold_average(b: Bound):
    return rounded(m.cross_fold(b.comparison), 4, *_STATS)


_RISK = ("avg_daily_impressions", "mape", "daily_revenue_at_risk", "annual_revenue_at_risk")


@case("SELECT model_name, fold_name, ad_unit, cpm, " + ", ".join(f"{r(c, 4)} AS {c}" for c in _RISK) + " FROM x_impact")
def business_impact(b: Bound):
    return rounded(b.impact, 4, *_RISK)


_SUMS = ("model_risk", "baseline_risk", "model_impressions", "total_annual_risk", "max_annual_risk", "savings_per_million")


@case(
    f"""SELECT {', '.join(f'{r(c, 4)} AS {c}' for c in _SUMS)}, high_risk_count FROM (SELECT *,
    (baseline_risk - model_risk) / nullif(model_impressions, 0) * 1e6 AS savings_per_million FROM (SELECT
    sum(annual_revenue_at_risk) FILTER (WHERE model_name = 'seasonal_zero_shot') AS model_risk,
    sum(annual_revenue_at_risk) FILTER (WHERE model_name = 'structural_xreg') AS baseline_risk,
    sum(avg_daily_impressions) FILTER (WHERE model_name = 'seasonal_zero_shot') AS model_impressions,
    sum(annual_revenue_at_risk) AS total_annual_risk, max(annual_revenue_at_risk) AS max_annual_risk,
    count(*) FILTER (WHERE annual_revenue_at_risk > 20) AS high_risk_count FROM x_impact))"""
)
def impact_summary(b: Bound):
    return rounded(m.impact_summary(b.impact, "seasonal_zero_shot", "structural_xreg", 20.0), 4, *_SUMS)


_RANKING = f"""SELECT rank() OVER (ORDER BY mean_mape) AS rank, model_name, {r('mean_mape', 2)} AS mean_mape_pct, {r('median_mape', 2)} AS median_mape_pct,
    {r('mean_rmse', 0)} AS mean_rmse, {r('cov', 1)} AS coverage_95_pct, {r('dr', 2)} AS daily_revenue_at_risk_usd, {r('ar', 0)} AS annual_revenue_at_risk_usd
    FROM (SELECT model_name, max(mean_value) FILTER (WHERE metric_name = 'mape') AS mean_mape, max(median_value) FILTER (WHERE metric_name = 'mape') AS median_mape,
    max(mean_value) FILTER (WHERE metric_name = 'rmse') AS mean_rmse, max(mean_value) FILTER (WHERE metric_name = 'coverage') AS cov
    FROM {{0}} WHERE fold_name = 'cross_fold_avg' GROUP BY model_name) LEFT JOIN (SELECT model_name, sum(daily_revenue_at_risk) AS dr,
    sum(annual_revenue_at_risk) AS ar FROM {{1}} GROUP BY model_name) USING (model_name)"""


@case(_RANKING.format("x_cmp_all", "x_impact_all"))
def model_ranking(b: Bound):
    run = run_walk_forward(b.daily, b.holidays, FOLDS)
    return m.model_ranking(run.comparison, run.impact)


@case(_RANKING.format("x_cmp", "x_impact"))
def model_ranking_wide(b: Bound):
    return m.model_ranking(b.comparison, b.impact)


@case("SELECT " + _CMP + " FROM x_cmp_all")
def walk_forward_comparison(b: Bound):
    return rounded(run_walk_forward(b.daily, b.holidays, FOLDS).comparison, 4, *_STATS)


@case(f"SELECT {_FC} FROM x_fc_all WHERE model_name IN ('seasonal_zero_shot', 'structural')")
def walk_forward_some_models(b: Bound):
    return _forecast(run_walk_forward(b.daily, b.holidays, FOLDS, models=(ZERO_SHOT, STRUCTURAL)).forecasts)


# ---- volatility and routing ---------------------------------------------------------------------


@case(f"SELECT ad_unit, {r('cv', 6)} AS cv FROM x_cv")
def volatility(b: Bound):
    return rounded(m.volatility(b.daily_wide), 6, "cv")


_MIXED = """(SELECT ad_unit, stddev_samp(daily_impressions) / nullif(avg(daily_impressions), 0) AS cv, count(*) AS n FROM
    (SELECT ad_unit, daily_impressions FROM x_raw UNION ALL SELECT ad_unit, daily_impressions FROM x_raw_gappy
     UNION ALL SELECT ad_unit, daily_impressions FROM x_raw_clock) GROUP BY ad_unit)"""


def _mixed(b: Bound):
    """Series of three kinds: steady, erratic and with only a month of history."""
    from tidecast.operators.rollup import daily_rollup

    return b.raw.unionByName(b.raw_gappy).unionByName(daily_rollup(b.hourly_clock))


@case(
    f"""SELECT ad_unit, {r('cv', 6)} AS cv, CASE WHEN cv < 0.5 THEN 'stable' ELSE 'event_driven' END AS content_type,
    CASE WHEN cv < 0.3 THEN 'regressor_eligible' WHEN cv < 0.5 THEN 'moderate' ELSE 'event_driven' END AS volatility_tier,
    cv > 0.5 AS high_volatility FROM {_MIXED}"""
)
def classify_series(b: Bound):
    return rounded(classify_volatility(m.volatility(_mixed(b))), 6, "cv")


@case(
    f"""SELECT ad_unit, n AS history_days, {r('cv', 6)} AS cv, CASE WHEN n < 90 THEN 'seasonal_zero_shot' WHEN cv >= 0.5 THEN 'seasonal_zero_shot'
    ELSE 'structural_xreg' END AS model_name FROM {_MIXED}"""
)
def route_models_by_volatility(b: Bound):
    return rounded(route_models(_mixed(b)), 6, "cv")


@case(
    f"""SELECT ad_unit, n AS history_days, {r('cv', 6)} AS cv, CASE WHEN n < 90 THEN 'seasonal_zero_shot' ELSE 'structural' END AS model_name
    FROM {_MIXED}"""
)
def route_models_explainable(b: Bound):
    return rounded(route_models(_mixed(b), need_explain=True), 6, "cv")


@case(
    f"""SELECT date, ad_unit, daily_impressions FROM x_raw_gappy WHERE ad_unit IN (SELECT ad_unit FROM {_MIXED} WHERE cv >= 0.5)"""
)
def filter_event_driven(b: Bound):
    rows = b.raw_gappy.select("date", "ad_unit", "daily_impressions")
    return m.filter_content_type(rows, m.volatility(b.raw_gappy), "event_driven")


@case(f"""SELECT date, ad_unit, daily_impressions FROM x_raw WHERE ad_unit IN (SELECT ad_unit FROM {_MIXED} WHERE cv < 0.5)""")
def filter_stable(b: Bound):
    rows = b.raw.select("date", "ad_unit", "daily_impressions")
    return m.filter_content_type(rows, m.volatility(b.raw), "stable")
