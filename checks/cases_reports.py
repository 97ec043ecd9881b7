"""Reports over forecasts, anomalies and decompositions, and the dashboard reads."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.bindings import EVENTS, FOLDS, UNITS, Bound
from checks.registry import case, rounded
from checks.sql_library import r
from tidecast.config import REGRESSOR, ZERO_SHOT
from tidecast.operators import anomalies as an
from tidecast.operators import decomposition as dec
from tidecast.operators import events as ev
from tidecast.operators import intervals as iv
from tidecast.operators import metrics as m
from tidecast.operators import serving as sv
from tidecast.sources.workspace import settle

# ---- anomalies ----------------------------------------------------------------------------------

_POINT = f"""date, ad_unit, daily_impressions, is_anomaly, {r('lower_bound', 4)} AS lower_bound, {r('upper_bound', 4)} AS upper_bound,
    {r('anomaly_probability', 6)} AS anomaly_probability"""


def _point(df):
    return rounded(rounded(df, 4, "lower_bound", "upper_bound"), 6, "anomaly_probability")


@case(f"SELECT {_POINT} FROM x_st_anom WHERE fold_name = 'fold_2' AND (anomaly_probability >= 0.9 OR is_anomaly)")
def flagged_points(b: Bound):
    return _point(an.flagged(b.anomalies, UNITS, "fold_2", 0.90))


@case(f"SELECT {_POINT} FROM x_st_anom WHERE fold_name = 'fold_1' AND ad_unit = 'N'")
def anomaly_series(b: Bound):
    return _point(an.anomaly_series(b.anomalies, "N", "fold_1"))


@case(
    f"""SELECT date, ad_unit, fold_name, {r('daily_impressions', 0)} AS impressions, {r('lower_bound', 0)} AS expected_lower,
    {r('upper_bound', 0)} AS expected_upper, {r('anomaly_probability', 4)} AS probability, CASE WHEN daily_impressions > upper_bound THEN 'HIGH_SPIKE'
    WHEN daily_impressions < lower_bound THEN 'LOW_DIP' ELSE 'UNKNOWN' END AS anomaly_type,
    {r('(daily_impressions - (lower_bound + upper_bound) / 2) / nullif((upper_bound - lower_bound) / 2, 0)', 2)} AS deviation_ratio
    FROM (SELECT * FROM x_sw_anom WHERE is_anomaly ORDER BY anomaly_probability DESC, date, ad_unit, fold_name LIMIT 100)"""
)
def explore_top_anomalies(b: Bound):
    return an.explore_top(b.anomalies_wide, 100)


@case(
    f"""SELECT t.date, n AS articles_affected, {r('p', 4)} AS avg_probability, x.ad_unit AS affected_article, x.fold_name,
    {r('x.anomaly_probability', 6)} AS probability FROM (SELECT date, count(*) AS n, avg(anomaly_probability) AS p
    FROM x_sw_anom WHERE is_anomaly GROUP BY date HAVING count(*) >= 3 ORDER BY n DESC, date LIMIT 50) t
    JOIN x_sw_anom x ON x.date = t.date AND x.is_anomaly"""
)
def anomalies_by_date(b: Bound):
    return rounded(an.anomalies_by_date(b.anomalies_wide_kept), 6, "probability")


@case(
    f"""SELECT ad_unit, count(*) AS total_days, count(*) FILTER (WHERE is_anomaly) AS anomaly_days,
    {r('avg(anomaly_probability) FILTER (WHERE is_anomaly)', 4)} AS avg_anomaly_probability,
    {r('100.0 * count(*) FILTER (WHERE is_anomaly) / count(*)', 1)} AS anomaly_rate_pct FROM x_sw_anom GROUP BY ad_unit"""
)
def anomaly_rate(b: Bound):
    return an.anomaly_rate(b.anomalies_wide)


_PROBE = f"date, ad_unit, fold_name, {r('daily_impressions', 0)} AS impressions, {r('anomaly_probability', 4)} AS probability, is_anomaly"


@case(f"SELECT {_PROBE} FROM x_st_anom WHERE month(date) = 2 AND dayofweek(date) = 0")
def probe_february_sundays(b: Bound):
    return an.probe_dates(b.anomalies, UNITS, an.sundays_in(2))


@case(f"SELECT {_PROBE} FROM x_st_anom WHERE date BETWEEN DATE '1999-07-15' AND DATE '1999-07-31'")
def probe_release_window(b: Bound):
    return an.probe_dates(b.anomalies, UNITS, F.col("date").between("1999-07-15", "1999-07-31"))


@case(
    f"""SELECT a.date, a.ad_unit, daily_impressions, {r('anomaly_probability', 6)} AS anomaly_probability, coalesce(e.event, '') AS event,
    coalesce(e.category, '') AS category, coalesce(g.guidance, '') AS forecastability FROM x_st_anom a
    LEFT JOIN x_ev e ON e.ad_unit = a.ad_unit AND e.date = a.date LEFT JOIN x_gd g ON g.category = e.category WHERE fold_name = 'fold_2'"""
)
def label_events(b: Bound):
    points = b.anomalies.where(F.col("fold_name") == "fold_2")
    return rounded(ev.label_events(points, b.events, b.guidance), 6, "anomaly_probability")


@case(
    f"""SELECT a.ad_unit, a.date, {r('anomaly_probability', 6)} AS anomaly_probability, coalesce(e.event, 'Anomaly') AS label
    FROM x_st_anom a LEFT JOIN x_ev e ON e.ad_unit = a.ad_unit AND e.date = a.date WHERE fold_name = 'fold_2' AND anomaly_probability >= 0.5"""
)
def annotate_anomalies(b: Bound):
    points = an.flagged(b.anomalies, None, "fold_2", 0.5)
    return rounded(ev.annotate_anomalies(points, b.events), 6, "anomaly_probability")


@case(
    f"""SELECT count(*) AS total_anomalies, count(e.event) AS matched_events, {r('avg(anomaly_probability)', 6)} AS avg_probability
    FROM x_st_anom a LEFT JOIN x_ev e ON e.ad_unit = a.ad_unit AND e.date = a.date WHERE fold_name = 'fold_2' AND anomaly_probability >= 0.3"""
)
def anomaly_summary(b: Bound):
    return rounded(ev.anomaly_summary(an.flagged(b.anomalies, UNITS, "fold_2", 0.3), b.events), 6, "avg_probability")


# ---- intervals ----------------------------------------------------------------------------------

_WIDTHS = f"""(SELECT ad_unit, fold_name, count(*) AS forecast_days, {r('avg(forecast_value)', 0)} AS avg_forecast,
    {r('avg(forecast_upper - forecast_lower)', 0)} AS avg_ci_width, {r('min(forecast_upper - forecast_lower)', 0)} AS min_ci_width,
    {r('max(forecast_upper - forecast_lower)', 0)} AS max_ci_width,
    {r('100 * avg((forecast_upper - forecast_lower) / nullif(forecast_value, 0))', 1)} AS avg_ci_pct,
    CASE WHEN 100 * avg((forecast_upper - forecast_lower) / nullif(forecast_value, 0)) < 20 THEN 'NARROW'
    WHEN 100 * avg((forecast_upper - forecast_lower) / nullif(forecast_value, 0)) > 100 THEN 'WIDE' ELSE 'NORMAL' END AS ci_flag
    FROM x_zero_wide GROUP BY ALL)"""


@case(f"SELECT * FROM {_WIDTHS}")
def interval_widths(b: Bound):
    return iv.ci_widths(b.forecasts_wide, ZERO_SHOT)


@case(
    f"""SELECT fold_name, count(DISTINCT ad_unit) AS num_articles, {r('avg(w)', 0)} AS overall_avg_ci_width, {r('avg(pct)', 1)} AS overall_avg_ci_pct,
    {r('stddev_samp(pct)', 1)} AS ci_pct_stddev FROM (SELECT *, forecast_upper - forecast_lower AS w,
    100 * (forecast_upper - forecast_lower) / nullif(forecast_value, 0) AS pct FROM x_zero_wide) GROUP BY fold_name"""
)
def interval_overall(b: Bound):
    return iv.ci_overall(b.forecasts_wide, ZERO_SHOT)


@case(
    f"""SELECT f AS ci_flag, count(w.ci_flag) AS n_rows, {r(f'100.0 * count(w.ci_flag) / (SELECT count(*) FROM {_WIDTHS})', 0)} AS share_pct
    FROM (SELECT unnest(['NORMAL', 'NARROW', 'WIDE']) AS f) LEFT JOIN {_WIDTHS} w ON w.ci_flag = f GROUP BY f"""
)
def interval_flag_summary(b: Bound):
    return iv.ci_flag_summary(iv.ci_widths(b.forecasts_wide, ZERO_SHOT))


@case(f"SELECT * FROM {_WIDTHS} WHERE ci_flag = 'WIDE' ORDER BY avg_ci_pct DESC, ad_unit, fold_name LIMIT 10")
def interval_top_wide(b: Bound):
    return iv.top_flags(iv.ci_widths(b.forecasts_wide, ZERO_SHOT), "WIDE", 10)


# ---- decomposition ------------------------------------------------------------------------------

_WEEKEND = "dayofweek(forecast_date) IN (0, 6)"
_STRENGTH = f"""(SELECT ad_unit, {r('a', 2)} AS weekend_component, {r('z', 2)} AS weekday_component, {r('(a - z) / nullif(v, 0)', 3)} AS weekend_effect,
    {r('wr / nullif(v, 0)', 3)} AS weekly_amplitude, {r('yr / nullif(v, 0)', 3)} AS yearly_amplitude, {r('hm', 2)} AS avg_holiday_effect,
    {r('hx', 2)} AS max_holiday_effect, {r('hx / nullif(v, 0)', 3)} AS holiday_impact_pct, {r('v', 0)} AS avg_forecast FROM (
    SELECT ad_unit, avg(weekly) FILTER (WHERE {_WEEKEND}) AS a, avg(weekly) FILTER (WHERE NOT {_WEEKEND}) AS z,
    max(weekly) - min(weekly) AS wr, max(yearly) - min(yearly) AS yr, avg(abs(heff)) AS hm, max(abs(heff)) AS hx, avg(fv) AS v
    FROM x_st_dec WHERE fold_name = 'fold_2' GROUP BY ad_unit))"""


@case(f"SELECT * FROM {_STRENGTH}")
def decomposition_stats(b: Bound):
    return dec.decomposition_stats(b.decomposition, "fold_2")


_RANGES = ("trend_range", "weekly_range", "yearly_range", "max_holiday_effect")


@case(
    f"""SELECT fold_name, ad_unit, {r('max(trend) - min(trend)', 4)} AS trend_range, {r('max(weekly) - min(weekly)', 4)} AS weekly_range,
    {r('max(yearly) - min(yearly)', 4)} AS yearly_range, {r('max(abs(heff))', 4)} AS max_holiday_effect FROM x_st_dec GROUP BY ALL"""
)
def component_stats(b: Bound):
    return rounded(dec.component_stats(b.decomposition), 4, *_RANGES)


@case(
    f"SELECT forecast_date AS date, {r('heff', 4)} AS holiday_effect FROM x_st_dec WHERE fold_name = 'fold_2' AND ad_unit = 'R' AND heff <> 0"
)
def holiday_effects(b: Bound):
    return rounded(dec.holiday_effects(b.decomposition, "R", "fold_2"), 4, "holiday_effect")


@case(
    f"""SELECT h.holiday_date, h.holiday_name, CASE WHEN d.heff <> 0 THEN {r('d.heff', 4)} END AS holiday_effect FROM x_hol h
    JOIN x_st_dec d ON d.forecast_date = h.holiday_date WHERE h.is_major AND d.fold_name = 'fold_2' AND d.ad_unit = 'R'"""
)
def annotate_holidays(b: Bound):
    return rounded(dec.annotate_holidays(settle(b.decomposition), b.holidays, "R", "fold_2"), 4, "holiday_effect")


@case(
    f"""SELECT u AS ad_unit, h AS hypothesis, CASE WHEN s.ad_unit IS NULL THEN 'MISSING' WHEN CASE h
    WHEN 'weekend_dip' THEN coalesce(weekend_effect, 0) < -0.10 WHEN 'strong_weekend_dip' THEN coalesce(weekend_effect, 0) < -0.15
    WHEN 'weekly_swing' THEN coalesce(weekly_amplitude, 0) > 0.20 WHEN 'yearly_swing' THEN coalesce(yearly_amplitude, 0) > 0.30
    ELSE true END THEN 'PASS' ELSE 'REVIEW' END AS status
    FROM (VALUES ('A', 'weekend_dip'), ('N', 'manual'), ('R', 'yearly_swing'), ('Z', 'weekly_swing')) w(u, h) LEFT JOIN {_STRENGTH} s ON s.ad_unit = u"""
)
def check_hypotheses(b: Bound):
    rules = {"A": "weekend_dip", "N": "manual", "R": "yearly_swing", "Z": "weekly_swing"}
    return dec.check_hypotheses(dec.decomposition_stats(b.decomposition, "fold_2"), rules)


@case(
    f"""SELECT 'ARIMA(' || f.p || ',' || f.d || ',0)' AS arima_order, f.d AS differencing_order, f.has_drift, article_count, avg_aic, min_aic,
    max_aic, ad_unit AS article, {r('aic', 2)} AS aic FROM x_sw_fit f JOIN (SELECT p, d, has_drift, count(*) AS article_count,
    {r('avg(aic)', 2)} AS avg_aic, {r('min(aic)', 2)} AS min_aic, {r('max(aic)', 2)} AS max_aic FROM x_sw_fit
    WHERE fold_name = 'fold_2' GROUP BY p, d, has_drift) g ON g.p = f.p AND g.d = f.d AND g.has_drift IS NOT DISTINCT FROM f.has_drift
    WHERE fold_name = 'fold_2'"""
)
def order_summary(b: Bound):
    return dec.order_summary(settle(_evaluated_wide(b)))


def _evaluated_wide(b: Bound):
    from tidecast.operators.folds import in_fold
    from tidecast.operators.structural import evaluate_orders, fit_structural

    params = fit_structural(in_fold(b.daily_wide, FOLDS[1:], "train"), b.holidays)
    return evaluate_orders(params)


@case("SELECT ad_unit FROM x_sw_fit WHERE fold_name = 'fold_2' AND has_steps")
def step_change_units(b: Bound):
    return dec.step_change_units(_evaluated_wide(b))


@case(
    f"""SELECT ad_unit, 'ARIMA(' || p || ',' || d || ',0)' AS arima_order, d AS differencing, has_drift, {r('aic', 2)} AS aic,
    has_holiday AS has_holiday_effect, has_steps AS has_step_changes FROM x_st_fit WHERE ad_unit = 'A'"""
)
def arima_order_of_series(b: Bound):
    return dec.arima_order(b.evaluated, "A")


# ---- dashboard reads ----------------------------------------------------------------------------


@case("SELECT date, ad_unit, daily_impressions FROM x_daily WHERE date >= DATE '2000-01-01'")
def get_actuals(b: Bound):
    return sv.get_actuals(b.daily, UNITS, start="2000-01-01")


@case("SELECT DISTINCT title AS ad_unit FROM x_hourly_wide")
def get_ad_units(b: Bound):
    return sv.get_ad_units(b.daily_wide)


_BOUNDS = f"""{r('forecast_value', 4)} AS forecast_value, {r('forecast_lower', 4)} AS lower_bound, {r('forecast_upper', 4)} AS upper_bound"""


@case(f"SELECT forecast_date AS date, ad_unit, model_name, {_BOUNDS} FROM x_fc WHERE fold_name = 'fold_2'")
def get_forecasts(b: Bound):
    rows = sv.get_forecasts(b.forecasts, UNITS, [ZERO_SHOT, REGRESSOR], "cross_fold_avg")
    return rounded(rows, 4, "forecast_value", "lower_bound", "upper_bound")


_SPREAD = ("metric_value", "median_value", "std_value", "min_value", "max_value")


@case(
    f"""SELECT model_name, metric_name, {r('mean_value', 4)} AS metric_value, {', '.join(f'{r(c, 4)} AS {c}' for c in _SPREAD[1:])}
    FROM x_cmp WHERE fold_name = 'cross_fold_avg'"""
)
def get_model_comparison(b: Bound):
    return rounded(sv.get_model_comparison(b.comparison), 4, *_SPREAD)


@case(f"SELECT model_name, ad_unit, metric_name, {r('metric_value', 4)} AS metric_value FROM x_metrics_wide WHERE fold_name = 'fold_2'")
def get_metrics_detail(b: Bound):
    return rounded(sv.get_metrics_detail(b.metrics_wide, "cross_fold_avg"), 4, "metric_value")


_RISK = ("avg_daily_impressions", "mape", "daily_revenue_at_risk", "annual_revenue_at_risk")


@case("SELECT model_name, ad_unit, cpm, " + ", ".join(f"{r(c, 4)} AS {c}" for c in _RISK) + " FROM x_impact WHERE fold_name = 'fold_1'")
def get_business_impact(b: Bound):
    return rounded(sv.get_business_impact(b.impact, "fold_1"), 4, *_RISK)


_SERVED = {
    "forecast_value": "fv", "lower_bound": "fv - half", "upper_bound": "fv + half", "trend": "trend", "weekly": "weekly",
    "yearly": "yearly", "holiday_effect": "heff", "spikes_and_dips": "0.0::DOUBLE", "step_changes": "level", "residual": "ar",
}


@case(
    "SELECT forecast_date AS date, "
    + ", ".join(f"{r(e, 4)} AS {c}" for c, e in _SERVED.items())
    + " FROM x_st_dec WHERE fold_name = 'fold_1' AND ad_unit = 'A'"
)
def get_decomposition(b: Bound):
    return rounded(sv.get_decomposition(b.decomposition, "A", "fold_1"), 4, *_SERVED)


@case(
    f"""SELECT forecast_date, ad_unit, fold_name, {r('forecast_value', 4)} AS forecast_value FROM x_zero
    WHERE fold_name = 'fold_1' AND forecast_date <= (SELECT min(forecast_date) FROM x_zero WHERE fold_name = 'fold_1') + 30"""
)
def clip_horizon(b: Bound):
    rows = settle(b.forecasts).where((F.col("fold_name") == "fold_1") & (F.col("model_name") == ZERO_SHOT))
    kept = sv.clip_horizon(rows, 30).select("forecast_date", "ad_unit", "fold_name", "forecast_value")
    return rounded(kept, 4, "forecast_value")


_METRICS = ("mape", "rmse", "mae", "mase", "coverage")
_PIVOT = "(SELECT model_name, " + ", ".join(
    f"max(mean_value) FILTER (WHERE metric_name = '{c}') AS {c}" for c in _METRICS
) + " FROM x_cmp WHERE fold_name = 'cross_fold_avg' GROUP BY model_name)"


@case(
    "SELECT model_name, "
    + ", ".join(f"{r(c, 4)} AS {c}" for c in _METRICS)
    + ", "
    + ", ".join(f"{c} = {'max' if c == 'coverage' else 'min'}({c}) OVER () AS best_{c}" for c in _METRICS)
    + f" FROM {_PIVOT}"
)
def metric_matrix(b: Bound):
    return rounded(sv.metric_matrix(b.comparison), 4, *_METRICS)


@case(
    f"""SELECT ad_unit, {r('a', 4)} AS seasonal_zero_shot, NULL::DOUBLE AS structural, {r('z', 4)} AS structural_xreg,
    CASE WHEN a <= z THEN 'seasonal_zero_shot' ELSE 'structural_xreg' END AS best_model FROM (SELECT ad_unit,
    max(mape) FILTER (WHERE model_name = 'seasonal_zero_shot') AS a, max(mape) FILTER (WHERE model_name = 'structural_xreg') AS z
    FROM x_scores_wide WHERE fold_name = 'fold_2' GROUP BY ad_unit)"""
)
def mape_matrix(b: Bound):
    return rounded(sv.mape_matrix(b.metrics_wide, "fold_2"), 4, "seasonal_zero_shot", "structural", "structural_xreg")


_QUART = """(SELECT model_name, count(*) AS n, quantile_cont(mape, 0.25) AS q1, quantile_cont(mape, 0.5) AS median,
    quantile_cont(mape, 0.75) AS q3 FROM x_scores_wide WHERE fold_name = 'fold_1' GROUP BY model_name)"""
_FENCED = f"""(SELECT s.model_name, s.ad_unit, s.mape, q.n, q1, median, q3, mape >= q1 - 1.5 * (q3 - q1) AS above, mape <= q3 + 1.5 * (q3 - q1) AS below
    FROM x_scores_wide s JOIN {_QUART} q USING (model_name) WHERE fold_name = 'fold_1')"""
_BOX = ("q1", "median", "q3", "whisker_low", "whisker_high")


@case(
    f"""SELECT model_name, n, {r('q1', 4)} AS q1, {r('median', 4)} AS median, {r('q3', 4)} AS q3, {r('min(mape) FILTER (WHERE above)', 4)} AS whisker_low,
    {r('max(mape) FILTER (WHERE below)', 4)} AS whisker_high, count(*) FILTER (WHERE NOT (above AND below)) AS n_outliers
    FROM {_FENCED} GROUP BY model_name, n, q1, median, q3"""
)
def mape_box(b: Bound):
    return rounded(sv.mape_box(b.metrics_wide, "fold_1"), 4, *_BOX)


@case(f"SELECT model_name, ad_unit, {r('mape', 4)} AS metric_value FROM {_FENCED} WHERE NOT (above AND below)")
def mape_outliers(b: Bound):
    return rounded(sv.mape_outliers(b.metrics_wide, "fold_1"), 4, "metric_value")


@case(
    f"""SELECT model_name, bin, count(*) AS n_residuals, CASE WHEN bin > 0 THEN {r('-200 + (bin - 1) * 20.0', 6)} END AS bin_start FROM (
    SELECT c.model_name, CAST(least(greatest(floor((round(c.forecast_value - d.daily_impressions, 6) + 200) / 20.0) + 1, 0), 21) AS BIGINT) AS bin
    FROM x_fc c JOIN x_daily d ON d.ad_unit = c.ad_unit AND d.date = c.forecast_date WHERE c.fold_name = 'fold_2') GROUP BY ALL"""
)
def residual_histogram(b: Bound):
    # Rounded first: a residual on the edge of a bin must not depend on the order of summation.
    rows = rounded(m.residuals(b.forecasts, b.daily_kept, "fold_2"), 6, "residual")
    return sv.residual_histogram(rows, -200.0, 200.0, 20)


@case(
    f"""SELECT CASE model_name WHEN 'seasonal_zero_shot' THEN 1 ELSE 3 END::BIGINT AS position, model_name, {r('mean_value', 4)} AS metric_value
    FROM x_cmp WHERE fold_name = 'cross_fold_avg' AND metric_name = 'mape'"""
)
def headline_mape(b: Bound):
    return rounded(sv.headline(b.comparison, "mape"), 4, "metric_value")
