"""Exploration and diagnosis."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.bindings import Bound
from checks.registry import case, rounded
from checks.sql_library import r
from tidecast.functions.quantiles import exact_quantiles
from tidecast.operators import explore


@case(
    f"""SELECT ad_unit, count(*) AS n_days, min(daily_impressions) AS min_impressions, max(daily_impressions) AS max_impressions,
    {r('avg(daily_impressions)', 4)} AS mean_impressions, {r('stddev_samp(daily_impressions)', 4)} AS std_impressions,
    quantile_disc(daily_impressions, 0.5) AS median_impressions, quantile_disc(daily_impressions, 0.25) AS p25_impressions,
    quantile_disc(daily_impressions, 0.75) AS p75_impressions, CAST(sum(daily_impressions) AS BIGINT) AS total_impressions
    FROM x_raw_wide GROUP BY ad_unit"""
)
def distribution_stats(b: Bound):
    return rounded(explore.distribution_stats(b.raw_wide), 4, "mean_impressions", "std_impressions")


_SPLIT = """(SELECT ad_unit, CAST(sum(daily_impressions) AS BIGINT) AS total_impressions, CAST(sum(desktop_impressions) AS BIGINT) AS desktop_sum,
    CAST(sum(mobile_impressions) AS BIGINT) AS mobile_sum, CAST(sum(desktop_impressions + mobile_impressions) AS BIGINT) AS computed_total,
    CAST(abs(sum(daily_impressions - desktop_impressions - mobile_impressions)) AS BIGINT) AS discrepancy FROM x_filled_gappy GROUP BY 1)"""


def _checked(b: Bound):
    """Filled days round each device by itself, so totals may differ."""
    from checks.bindings import GAPPY_END, GAPPY_START
    from tidecast.operators.gaps import backfill_gaps

    return explore.device_split_check(backfill_gaps(b.daily_gappy, b.holidays, GAPPY_START, GAPPY_END))


@case(f"SELECT * FROM {_SPLIT}")
def device_split_check(b: Bound):
    return _checked(b)


@case(
    f"""SELECT NOT bool_or(discrepancy > 0) AS all_splits_valid, max(discrepancy) AS max_discrepancy,
    count(*) FILTER (WHERE discrepancy > 0) AS problem_units FROM {_SPLIT}"""
)
def device_split_verdict(b: Bound):
    return explore.device_split_verdict(_checked(b))


@case(
    f"""SELECT ad_unit, total_impressions, desktop_sum, mobile_sum,
    {r('coalesce(100.0 * desktop_sum / nullif(total_impressions, 0), 0)', 6)} AS desktop_pct FROM {_SPLIT}"""
)
def device_mix(b: Bound):
    return rounded(explore.device_mix(_checked(b)), 6, "desktop_pct")


_WEEKDAYS = """(SELECT ad_unit, dayofweek(date) + 1 AS day_of_week, avg(daily_impressions) AS v, count(*) AS n FROM x_raw_wide GROUP BY ALL)"""


@case(f"SELECT ad_unit, day_of_week, {r('v', 4)} AS avg_impressions, n AS n_observations FROM {_WEEKDAYS}")
def weekday_patterns(b: Bound):
    return rounded(explore.weekday_patterns(b.raw_wide), 4, "avg_impressions")


@case(
    "SELECT ad_unit, "
    + ", ".join(
        f"{r(f'max(v) FILTER (WHERE day_of_week = {i}) / max(v)', 6)} AS {c}"
        for i, c in enumerate(explore.WEEKDAY_COLUMNS, 1)
    )
    + f" FROM {_WEEKDAYS} GROUP BY ad_unit"
)
def weekday_heatmap(b: Bound):
    return rounded(explore.weekday_heatmap(explore.weekday_patterns(b.raw_wide)), 6, *explore.WEEKDAY_COLUMNS)


_TOTALS = "(SELECT ad_unit, CAST(sum(daily_impressions) AS BIGINT) AS t FROM x_raw_wide GROUP BY 1)"
_MEDIAN = f"(SELECT quantile_cont(t::DOUBLE, 0.5) AS m FROM {_TOTALS})"


@case(
    f"""SELECT ad_unit, t AS total_impressions, m AS median_total, CASE WHEN t > m THEN 'high' ELSE 'low' END AS side
    FROM {_TOTALS}, {_MEDIAN}"""
)
def traffic_sides(b: Bound):
    return explore.traffic_sides(b.stats_wide_kept)


@case(
    f"""SELECT max(t) AS max_total, min(t) AS min_total, {r('max(t) / min(t)', 1)} AS max_min_ratio, max_by(ad_unit, t) AS max_ad_unit,
    min_by(ad_unit, t) AS min_ad_unit, count(*) FILTER (WHERE t > m) AS high_traffic_units,
    count(*) FILTER (WHERE t <= m) AS low_traffic_units FROM {_TOTALS}, {_MEDIAN}"""
)
def distribution_balance(b: Bound):
    return explore.distribution_balance(b.stats_wide_kept)


@case(
    f"""SELECT ad_unit, h.holiday_name, {r('avg(daily_impressions)', 4)} AS avg_impressions_on_holiday
    FROM x_raw JOIN x_hol h ON h.holiday_date = date WHERE is_major GROUP BY ALL"""
)
def holiday_impact(b: Bound):
    return rounded(explore.holiday_impact(b.raw, b.holidays), 4, "avg_impressions_on_holiday")


@case(
    f"""SELECT ad_unit, date, daily_impressions, {r('CASE WHEN count(*) OVER a = 7 THEN avg(daily_impressions) OVER a END', 6)} AS rolling_7d,
    {r('CASE WHEN count(*) OVER b = 30 THEN avg(daily_impressions) OVER b END', 6)} AS rolling_30d FROM x_daily
    WINDOW a AS (PARTITION BY ad_unit ORDER BY date ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING),
    b AS (PARTITION BY ad_unit ORDER BY date ROWS BETWEEN 15 PRECEDING AND 14 FOLLOWING)"""
)
def moving_averages(b: Bound):
    return rounded(explore.moving_averages(b.daily), 6, "rolling_7d", "rolling_30d")


_WEEKEND = """(SELECT {by}, avg(daily_impressions) FILTER (WHERE dayofweek(date) BETWEEN 1 AND 5) AS wd,
    avg(daily_impressions) FILTER (WHERE dayofweek(date) IN (0, 6)) AS we FROM x_daily_wide GROUP BY ALL)"""
_WEEKEND_OUT = f"{r('wd', 0)} AS weekday_avg, {r('we', 0)} AS weekend_avg, {r('100 * (we - wd) / nullif(wd, 0)', 1)} AS weekend_effect_pct"


@case(f"SELECT ad_unit, year, {_WEEKEND_OUT} FROM {_WEEKEND.format(by='ad_unit, year(date) AS year')}")
def weekend_effect_by_year(b: Bound):
    return explore.weekend_effect_by_year(b.daily_wide)


@case(
    f"""SELECT ad_unit, {_WEEKEND_OUT}, CASE WHEN we / wd - 1 < -0.15 THEN 'Strong weekday bias' WHEN we / wd - 1 < -0.05
    THEN 'Moderate weekday bias' WHEN we / wd - 1 > 0.05 THEN 'Weekend increase' ELSE 'Relatively flat' END AS pattern_type
    FROM {_WEEKEND.format(by='ad_unit')}"""
)
def weekend_pattern(b: Bound):
    return explore.weekend_pattern(b.daily_wide)


@case(
    f"""SELECT effect_a, effect_b, {r('abs(effect_a - effect_b)', 1)} AS difference, CASE WHEN effect_b < -15 AND effect_a > -10
    THEN 'CONFIRMED' ELSE 'NOT_CONFIRMED' END AS finding FROM (SELECT max(e) FILTER (WHERE ad_unit = 'Brand#1') AS effect_a,
    max(e) FILTER (WHERE ad_unit = 'Brand#2') AS effect_b FROM (SELECT ad_unit, {r('100 * (we - wd) / nullif(wd, 0)', 1)} AS e
    FROM {_WEEKEND.format(by='ad_unit')}))"""
)
def compare_weekend(b: Bound):
    return explore.compare_weekend(explore.weekend_pattern(b.daily_wide), "Brand#1", "Brand#2")


_MONTHLY = """(SELECT *, lag(v) OVER (PARTITION BY ad_unit ORDER BY ms) AS pv FROM (SELECT ad_unit, date_trunc('month', date) AS ms,
    avg(daily_impressions) AS v, min(daily_impressions) AS lo, max(daily_impressions) AS hi FROM x_daily GROUP BY ALL))"""


@case(
    f"""SELECT ad_unit, strftime(ms, '%Y-%m') AS month, {r('v', 0)} AS avg_daily, lo AS min_daily, hi AS max_daily,
    {r('100 * (v - pv) / nullif(pv, 0)', 1)} AS mom_change_pct FROM {_MONTHLY}"""
)
def monthly_trend(b: Bound):
    return explore.monthly_trend(b.daily)


@case(
    f"""SELECT ad_unit, f AS first_avg, l AS last_avg, {r('coalesce(100 * (l - f) / nullif(f, 0), 0)', 4)} AS overall_change_pct,
    {r('100 * s / nullif(a, 0)', 4)} AS variation_pct, {r('w', 4)} AS winter_avg, {r('su', 4)} AS summer_avg,
    {r('w / nullif(su, 0)', 6)} AS seasonal_ratio, CASE WHEN abs(100 * (l - f) / nullif(f, 0)) > 20 THEN 'STRONG_TREND' ELSE 'SEASONAL' END AS finding
    FROM (SELECT ad_unit, arg_min(rv, ms) AS f, arg_max(rv, ms) AS l, avg(rv) AS a, stddev_samp(rv) AS s,
    avg(rv) FILTER (WHERE month(ms) IN (10, 11, 12, 1, 2, 3)) AS w, avg(rv) FILTER (WHERE month(ms) BETWEEN 4 AND 9) AS su
    FROM (SELECT *, {r('v', 0)} AS rv FROM {_MONTHLY}) GROUP BY ad_unit)"""
)
def trend_summary(b: Bound):
    out = explore.trend_summary(explore.monthly_trend(b.daily))
    out = rounded(out, 4, "overall_change_pct", "variation_pct", "winter_avg", "summer_avg")
    return rounded(out, 6, "seasonal_ratio")


_YEARLY = f"""(SELECT ad_unit, year(date) AS year, {r('avg(daily_impressions)', 0)} AS avg_daily, {r('stddev_samp(daily_impressions)', 0)} AS stddev,
    {r('stddev_samp(daily_impressions) / nullif(avg(daily_impressions), 0)', 2)} AS cv, min(daily_impressions) AS min_daily,
    max(daily_impressions) AS max_daily, count(*) AS days FROM x_daily_wide GROUP BY ALL)"""


@case(f"SELECT * FROM {_YEARLY}")
def yearly_baseline(b: Bound):
    return explore.yearly_baseline(b.daily_wide)


_PAIR = """(SELECT ad_unit, max({c}) FILTER (WHERE year = 1997) AS value_first, max({c}) FILTER (WHERE year = 1999) AS value_second
    FROM {t} GROUP BY ad_unit)"""


@case(
    f"""SELECT ad_unit, value_first, value_second, {r('100 * (value_second - value_first) / nullif(value_first, 0)', 6)} AS shift,
    CASE WHEN abs(100 * (value_second - value_first) / nullif(value_first, 0)) > 15 THEN 'SIGNIFICANT' ELSE 'STABLE' END AS finding
    FROM {_PAIR.format(c='avg_daily', t=_YEARLY)}"""
)
def baseline_year_shift(b: Bound):
    table = explore.yearly_baseline(b.daily_wide)
    return rounded(explore.year_shift(table, "avg_daily", 1997, 1999, relative=True), 6, "shift")


@case(
    f"""SELECT ad_unit, value_first, value_second, {r('value_second - value_first', 6)} AS shift,
    CASE WHEN abs(value_second - value_first) > 5 THEN 'SIGNIFICANT' ELSE 'STABLE' END AS finding
    FROM {_PAIR.format(c='weekend_effect_pct', t=f"(SELECT ad_unit, year, {_WEEKEND_OUT} FROM {_WEEKEND.format(by='ad_unit, year(date) AS year')})")}"""
)
def weekend_year_shift(b: Bound):
    table = explore.weekend_effect_by_year(b.daily_wide)
    return rounded(explore.year_shift(table, "weekend_effect_pct", 1997, 1999, relative=False), 6, "shift")


@case(
    f"""SELECT ad_unit, month, {r('a', 4)} AS avg_first, {r('z', 4)} AS avg_second, round_even(100 * (z - a) / nullif(a, 0), 1) AS yoy_change
    FROM (SELECT ad_unit, month(date) AS month, avg(daily_impressions) FILTER (WHERE year(date) = 1997) AS a,
    avg(daily_impressions) FILTER (WHERE year(date) = 1999) AS z FROM x_daily GROUP BY ALL)"""
)
def month_yoy(b: Bound):
    return rounded(explore.month_yoy(b.daily, 1997, 1999), 4, "avg_first", "avg_second")


@case(
    """SELECT ad_unit, bool_or(term IS NOT NULL) AS found FROM (SELECT p_type AS ad_unit FROM part UNION SELECT c_mktsegment FROM customer) u LEFT JOIN
    (SELECT DISTINCT upper(p_type) AS term FROM part) t ON lower(u.ad_unit) = lower(t.term)
    OR lower(replace(u.ad_unit, '_', ' ')) = lower(t.term) GROUP BY ad_unit"""
)
def match_terms(b: Bound):
    units = b.table("part").select(F.col("p_type").alias("ad_unit")).unionByName(b.table("customer").select(F.col("c_mktsegment").alias("ad_unit")))
    terms = b.table("part").select(F.upper("p_type").alias("term"))
    return explore.match_terms(units, terms)


@case(
    f"""SELECT title AS term, count(DISTINCT date_trunc('week', datehour)) AS weeks_with_data, CAST(min(date_trunc('week', datehour)) AS DATE) AS first_week,
    CAST(max(date_trunc('week', datehour)) AS DATE) AS last_week, {r('avg(views)', 6)} AS avg_score FROM x_hourly_wide GROUP BY title"""
)
def term_coverage(b: Bound):
    terms = b.hourly_wide.select(
        F.col("title").alias("term"),
        F.to_date(F.date_trunc("week", "datehour")).alias("week"),
        F.col("views").alias("score"),
    )
    return rounded(explore.term_coverage(terms), 6, "avg_score")


@case(
    """SELECT l_returnflag, count(*) AS n, round(quantile_cont(l_extendedprice, 0.01), 4) AS low, round(quantile_cont(l_extendedprice, 0.5), 4) AS median,
    round(quantile_cont(l_extendedprice, 0.999), 4) AS high FROM (SELECT l_returnflag, l_extendedprice::DOUBLE AS l_extendedprice FROM lineitem) GROUP BY l_returnflag"""
)
def quantiles_of_all_lines(b: Bound):
    marks = {"low": 0.01, "median": 0.5, "high": 0.999}
    return rounded(exact_quantiles(b.table("lineitem"), "l_extendedprice", marks, ["l_returnflag"]), 4, *marks)
