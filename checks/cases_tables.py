"""Sources, features, gaps and quality checks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks.bindings import END, FOLDS, GAPPY_END, GAPPY_START, START, UNITS, Bound
from checks.registry import case, rounded
from checks.sql_library import LIBRARY, featured, r
from tidecast.operators import calendar as cal
from tidecast.operators import gaps, quality
from tidecast.operators.folds import walk_forward_splits
from tidecast.operators.rollup import daily_rollup, extract_hourly
from tidecast.plans.daily_load import load_daily
from tidecast.plans.walk_forward import fold_features
from tidecast.sources import tables
from tidecast.sources.holidays import holidays_in_range
from tidecast.sources.workspace import checkpoint_dir, settle

_ROWS_SPAN = "(DATE '2001-11-04' - DATE '1995-01-02') + 1"


def _shards(b: Bound) -> list[DataFrame]:
    """Two shards of the counts, as stored by period."""
    split = F.lit("1998-06-30").cast("date")
    return [b.hourly.where(F.col("datehour") < split), b.hourly.where(F.col("datehour") >= split)]


# ---- sources ------------------------------------------------------------------------------------


@case(
    """SELECT title, wiki, count(*) AS hours, CAST(sum(views) AS BIGINT) AS views, CAST(min(datehour) AS DATE) AS first_day,
    CAST(max(datehour) AS DATE) AS last_day FROM x_hourly GROUP BY ALL"""
)
def extract_hourly_shards(b: Bound):
    return (
        extract_hourly(_shards(b), START, END, UNITS)
        .groupBy("title", "wiki")
        .agg(
            F.count(F.lit(1)).alias("hours"),
            F.sum("views").alias("views"),
            F.to_date(F.min("datehour")).alias("first_day"),
            F.to_date(F.max("datehour")).alias("last_day"),
        )
    )


@case("SELECT * FROM x_raw")
def daily_rollup_lines(b: Bound):
    return b.raw


@case("SELECT * FROM x_raw_clock")
def daily_rollup_clock_times(b: Bound):
    return daily_rollup(b.hourly_clock)


@case("SELECT * FROM x_raw_wide")
def daily_rollup_wide(b: Bound):
    return b.raw_wide


@case("SELECT * FROM x_daily")
def load_daily_from_shards(b: Bound):
    return load_daily(_shards(b), b.holidays, START, END, UNITS)


@case(
    """SELECT h.holiday_date, h.holiday_name, h.is_major, count(d.date) AS unit_days
    FROM x_daily d JOIN x_hol h ON h.holiday_date = d.date GROUP BY ALL"""
)
def holidays_in_data_range(b: Bound):
    named = holidays_in_range(b.holidays.withColumn("is_major", F.col("is_major").cast("string")), START, END)
    days = b.daily.select(F.col("date").alias("holiday_date"))
    return days.join(named, "holiday_date").groupBy("holiday_date", "holiday_name", "is_major").agg(
        F.count(F.lit(1)).alias("unit_days")
    )


@case(
    """SELECT CAST(g.d AS DATE) AS date, u.ad_unit, coalesce(w.daily_impressions, 0) AS daily_impressions
    FROM generate_series(DATE '1995-01-01', DATE '2001-08-01', INTERVAL 1 DAY) g(d), (SELECT DISTINCT ad_unit FROM x_raw_gappy) u
    LEFT JOIN x_raw_gappy w ON w.date = CAST(g.d AS DATE) AND w.ad_unit = u.ad_unit"""
)
def insert_missing_days(b: Bound):
    target = b.raw_gappy.select("date", "ad_unit", "daily_impressions")
    zeros = cal.full_grid(b.raw_gappy, GAPPY_START, GAPPY_END).withColumn(
        "daily_impressions", F.lit(0).cast("bigint")
    )
    return tables.insert_missing(target, zeros, ["date", "ad_unit"])


@case(
    """SELECT date, min(src) AS source FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS date, 'dim' AS src FROM orders
    UNION ALL SELECT DISTINCT CAST(l_shipdate AS DATE), 'new' FROM lineitem) GROUP BY date"""
)
def extend_dimension_dates(b: Bound):
    def days(table, column, tag):
        return b.table(table).select(F.to_date(column).alias("date")).distinct().withColumn("source", F.lit(tag))

    return tables.extend_dimension(days("orders", "o_orderdate", "dim"), days("lineitem", "l_shipdate", "new"), "date")


@case("SELECT date, ad_unit, daily_impressions FROM x_raw WHERE date >= DATE '2001-11-04' - 730")
def recent_days(b: Bound):
    return tables.recent(b.raw, 730, END).select("date", "ad_unit", "daily_impressions")


@case(
    """SELECT ad_unit, date, daily_impressions FROM x_raw WHERE date BETWEEN DATE '1996-01-01' AND DATE '2000-12-31'"""
)
def date_bounds(b: Bound):
    rows = tables.date_filter(tables.window_slice(b.raw, "1996-01-01", END), end="2000-12-31")
    return rows.select("ad_unit", "date", "daily_impressions")


@case(
    " UNION ALL ".join(
        f"""SELECT {i} AS position, '{c}' AS column_name, '{t}' AS data_type, count({c}) AS non_null, count(*) AS row_count FROM x_daily"""
        for i, (c, t) in enumerate(
            [
                ("date", "date"), ("ad_unit", "string"), ("daily_impressions", "bigint"), ("desktop_impressions", "bigint"),
                ("mobile_impressions", "bigint"), ("day_of_week", "bigint"), ("is_weekend", "boolean"),
                ("quarter", "bigint"), ("week_of_year", "bigint"), ("is_holiday", "boolean"),
                ("holiday_name", "string"), ("days_to_next_holiday", "bigint"),
            ],
            1,
        )
    ).replace("SELECT 1 AS", "SELECT 1::BIGINT AS")
)
def profile_daily(b: Bound):
    return tables.profile_table(b.daily)


@case(
    f"""SELECT ad_unit, count(*) AS days, CAST(sum(daily_impressions) AS BIGINT) AS total FROM x_raw
    WHERE ad_unit IN ('A', 'N', 'R') AND date >= DATE '1995-01-02' GROUP BY ad_unit"""
)
def sql_with_parameters(b: Bound):
    return tables.run_sql(
        b.spark,
        """SELECT ad_unit, count(*) AS days, sum(daily_impressions) AS total FROM {daily}
        WHERE array_contains(:units, ad_unit) AND date >= :first GROUP BY ad_unit""",
        {"units": UNITS, "first": START},
        daily=b.raw,
    )


@case(
    """SELECT date, CASE WHEN ad_unit <> 'N' THEN 'r=1' END AS part, daily_impressions * CASE WHEN ad_unit = 'N' THEN 2 ELSE 1 END AS daily_impressions
    FROM x_raw WHERE ad_unit <> 'A'"""
)
def replace_scopes_of_table(b: Bound):
    """Three partitions stored; one of them emptied, the one without a key replaced."""
    part = F.when(F.col("ad_unit") == "A", F.lit("a:b/c")).when(F.col("ad_unit") == "R", F.lit("r=1"))
    rows = settle(b.raw.select("date", part.alias("part"), "daily_impressions"))
    path = f"{checkpoint_dir(b.spark)}/tables/{uuid.uuid4().hex}"
    tables.replace_scope(rows, path, ["part"], F.lit(True))
    tables.replace_scope(rows.where(F.lit(False)), path, ["part"], F.col("part") == "a:b/c")
    doubled = rows.withColumn("daily_impressions", F.col("daily_impressions") * 2)
    tables.replace_scope(doubled, path, ["part"], F.col("part").isNull())
    return b.spark.read.schema(rows.schema).parquet(path).select("date", "part", "daily_impressions")


_SHOWN = ("date", "ad_unit", "daily_impressions", "is_holiday", "holiday_name")


@case(f"SELECT {', '.join(_SHOWN)} FROM x_daily ORDER BY md5('7|' || ad_unit || '|' || date::VARCHAR) LIMIT 10")
def spot_check_rows(b: Bound):
    return tables.spot_check(b.daily.select(*_SHOWN), ["ad_unit", "date"], 10, seed=7)


@case(f"SELECT {', '.join(_SHOWN)} FROM x_daily WHERE is_holiday ORDER BY date, ad_unit LIMIT 10")
def sample_holiday_rows(b: Bound):
    return tables.sample_rows(b.daily.select(*_SHOWN), F.col("is_holiday"), ["date", "ad_unit"], 10)


# ---- features -----------------------------------------------------------------------------------


@case("SELECT * FROM x_built")
def build_daily_features(b: Bound):
    return cal.build_daily(b.raw, b.holidays)


@case("SELECT * FROM x_fills_gappy")
def gap_fill_rows(b: Bound):
    return gaps.gap_fills(b.raw_gappy, GAPPY_START, GAPPY_END)


@case("SELECT * FROM x_filled_gappy")
def backfill_gaps(b: Bound):
    return gaps.backfill_gaps(b.daily_gappy, b.holidays, GAPPY_START, GAPPY_END)


@case("SELECT * FROM x_future")
def future_features(b: Bound):
    return fold_features(b.daily, b.holidays, FOLDS)


@case(
    """SELECT date, ad_unit, day_of_week, is_weekend::BIGINT AS is_weekend, is_holiday::BIGINT AS is_holiday,
    coalesce(days_to_next_holiday, 0) AS days_to_next_holiday FROM x_daily"""
)
def regressor_features(b: Bound):
    return cal.xreg_features(b.daily).select("date", "ad_unit", *cal.REGRESSORS)


@case(
    """SELECT u.date, min(k.holiday_date) AS next_holiday, CAST(min(k.holiday_date) - u.date AS BIGINT) AS days_to_next_holiday
    FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders) u LEFT JOIN x_hol k ON k.holiday_date >= u.date GROUP BY u.date"""
)
def next_holiday_of_dates(b: Bound):
    dates = b.table("orders").select(F.to_date("o_orderdate").alias("date")).distinct()
    return cal.next_holiday(dates, b.holidays)


@case(
    """SELECT CAST(g.d AS DATE) AS date, u.ad_unit, w.date IS NULL AS is_missing
    FROM generate_series(DATE '1995-01-01', DATE '2001-08-01', INTERVAL 1 DAY) g(d), (SELECT DISTINCT ad_unit FROM x_raw_gappy) u
    LEFT JOIN x_raw_gappy w ON w.date = CAST(g.d AS DATE) AND w.ad_unit = u.ad_unit"""
)
def full_grid_with_missing(b: Bound):
    grid = cal.full_grid(b.raw_gappy, GAPPY_START, GAPPY_END)
    present = b.raw_gappy.select("date", "ad_unit", F.lit(True).alias("present"))
    return grid.join(present, ["date", "ad_unit"], "left").select(
        "date", "ad_unit", F.col("present").isNull().alias("is_missing")
    )


@case(
    """SELECT fold_name, split, ad_unit, count(*) AS days, min(date) AS first_day, max(date) AS last_day FROM (
    SELECT f.fold_name, CASE WHEN d.date <= f.train_end THEN 'train' ELSE 'test' END AS split, d.ad_unit, d.date
    FROM x_daily d JOIN x_folds f ON d.date BETWEEN f.train_start AND f.test_end) GROUP BY ALL"""
)
def walk_forward_split_days(b: Bound):
    return walk_forward_splits(b.daily, FOLDS).groupBy("fold_name", "split", "ad_unit").agg(
        F.count(F.lit(1)).alias("days"), F.min("date").alias("first_day"), F.max("date").alias("last_day")
    )


# ---- quality checks -----------------------------------------------------------------------------

_PASS = "CASE WHEN {} THEN 'PASS' ELSE 'FAIL' END AS status"


@case(f"SELECT 'row_count' AS check, {_PASS.format('count(*) >= 7000')}, count(*) AS row_count FROM x_daily")
def check_row_count(b: Bound):
    return quality.check_row_count(b.daily, 7000)


@case(
    f"""SELECT 'no_nulls' AS check, {_PASS.format('count(*) = count(days_to_next_holiday)')},
    count(*) - count(days_to_next_holiday) AS null_count FROM x_daily"""
)
def check_no_nulls(b: Bound):
    return quality.check_no_nulls(b.daily, ["date", "ad_unit", "daily_impressions", "days_to_next_holiday"])


_GAPS = """(SELECT ad_unit, date, lag(date) OVER (PARTITION BY ad_unit ORDER BY date) AS prev_date,
    date - lag(date) OVER (PARTITION BY ad_unit ORDER BY date) AS gap_days FROM {})"""


@case(
    f"""SELECT 'date_continuity' AS check, {_PASS.format('n = 0')}, n AS gap_count FROM
    (SELECT count(*) AS n FROM {_GAPS.format('x_raw_gappy')} WHERE gap_days > 1)"""
)
def check_continuity_gappy(b: Bound):
    return quality.check_continuity(b.raw_gappy)


@case(
    f"""SELECT 'date_continuity' AS check, {_PASS.format('n = 0')}, n AS gap_count FROM
    (SELECT count(*) AS n FROM {_GAPS.format('x_daily')} WHERE gap_days > 1)"""
)
def check_continuity_filled(b: Bound):
    return quality.check_continuity(b.daily)


@case(
    f"""SELECT 'holiday_join' AS check, {_PASS.format('h > 0 AND nd = 0 AND ev = 0')}, tr AS total_rows, h AS holiday_rows,
    nd AS null_days_count, ev AS edge_case_violations FROM (SELECT count(*) AS tr, count(*) FILTER (WHERE is_holiday) AS h,
    count(*) FILTER (WHERE days_to_next_holiday IS NULL) AS nd,
    count(*) FILTER (WHERE is_holiday AND days_to_next_holiday <> 0) AS ev FROM x_daily)"""
)
def check_holiday_join(b: Bound):
    return quality.check_holiday_join(b.daily)


@case(
    f"""SELECT 'forecast_coverage' AS check, {_PASS.format('m = 2 AND u = 3')}, m AS model_count, u AS ad_unit_count, n AS total_rows
    FROM (SELECT count(DISTINCT model_name) AS m, count(DISTINCT ad_unit) AS u, count(*) AS n FROM x_fc WHERE fold_name = 'fold_1')"""
)
def check_forecast_coverage(b: Bound):
    return quality.check_forecast_coverage(b.forecasts, "fold_1", models=2, units=3)


@case(
    f"""SELECT 'metrics_completeness' AS check, {_PASS.format('m = 2 AND u = 3 AND k = 5')}, m AS model_count, u AS ad_unit_count,
    k AS metric_count, n AS total_rows FROM (SELECT count(DISTINCT model_name) AS m, count(DISTINCT ad_unit) AS u,
    count(DISTINCT metric_name) AS k, count(*) AS n FROM x_metrics WHERE fold_name = 'fold_2')"""
)
def check_metrics_complete(b: Bound):
    return quality.check_metrics_complete(b.metrics, "fold_2", models=2, units=3)


@case(
    f"""SELECT 'no_infinite_metrics' AS check, {_PASS.format('n = 0')}, n AS invalid_count FROM (SELECT count(*) AS n FROM x_metrics
    WHERE fold_name = 'fold_1' AND (isnan(metric_value) OR isinf(metric_value) OR (metric_value IS NULL AND metric_name <> 'mase')))"""
)
def check_finite_metrics(b: Bound):
    return quality.check_finite(b.metrics, "fold_1")


@case(
    f"""SELECT 'row_rules' AS check, {_PASS.format('s + w + q + h = 0')}, s AS split_violations, w AS weekday_violations,
    q AS quarter_violations, h AS name_violations FROM (SELECT
    count(*) FILTER (WHERE desktop_impressions + mobile_impressions <> daily_impressions) AS s,
    count(*) FILTER (WHERE day_of_week NOT BETWEEN 1 AND 7) AS w, count(*) FILTER (WHERE quarter NOT BETWEEN 1 AND 4) AS q,
    count(*) FILTER (WHERE is_holiday AND holiday_name IS NULL) AS h FROM x_filled_gappy)"""
)
def check_row_rules(b: Bound):
    return quality.check_row_rules(gaps.backfill_gaps(b.daily_gappy, b.holidays, GAPPY_START, GAPPY_END))


@case(
    f"""SELECT 'holiday_span' AS check, {_PASS.format("lo <= a AND hi >= z AND hi >= z + 92")}, c AS holiday_count,
    lo AS holiday_min, hi AS holiday_max, lo <= a AND hi >= z AS covers_training, hi >= z + 92 AS covers_forecast
    FROM (SELECT count(*) AS c, min(holiday_date) AS lo, max(holiday_date) AS hi FROM x_hol
          WHERE holiday_date IN (SELECT date FROM x_daily)),
         (SELECT DATE '1995-01-02' AS a, DATE '2000-12-31' AS z)"""
)
def check_holiday_span(b: Bound):
    used = b.holidays.join(b.daily.select(F.col("date").alias("holiday_date")), "holiday_date", "left_semi")
    return quality.check_holiday_span(used, START, FOLDS[1].test_end, 92)


_VALIDATED = f"""SELECT 'row_count' AS check, {_PASS.format('count(*) >= 7000')} FROM x_daily UNION ALL
    SELECT 'no_nulls', CASE WHEN bool_or(date IS NULL OR ad_unit IS NULL OR daily_impressions IS NULL OR day_of_week IS NULL)
        THEN 'FAIL' ELSE 'PASS' END FROM x_daily UNION ALL
    SELECT 'date_continuity', CASE WHEN bool_or(gap_days > 1) THEN 'FAIL' ELSE 'PASS' END FROM {_GAPS.format('x_daily')} UNION ALL
    SELECT 'holiday_join', CASE WHEN bool_or(is_holiday) AND NOT bool_or(days_to_next_holiday IS NULL)
        AND NOT bool_or(is_holiday AND days_to_next_holiday <> 0) THEN 'PASS' ELSE 'FAIL' END FROM x_daily"""


@case(_VALIDATED)
def validate_daily(b: Bound):
    return quality.validate_daily(b.daily, 7000)


_QC = "SELECT '{}' AS check_name, ad_unit, n AS {}, CASE WHEN n = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM ({})"


@case(
    f"""SELECT 'row_count_check' AS check_name, ad_unit, count(*) AS actual_count, {_ROWS_SPAN} AS expected_count,
    CASE WHEN count(*) = {_ROWS_SPAN} THEN 'PASS' ELSE 'FAIL' END AS status FROM x_raw GROUP BY ad_unit"""
)
def qc_row_count(b: Bound):
    return quality.qc_row_count(b.raw, START, END)


@case(_QC.format("null_impressions_check", "null_count", "SELECT ad_unit, count(*) - count(daily_impressions) AS n FROM x_daily GROUP BY 1"))
def qc_nulls(b: Bound):
    return quality.qc_nulls(b.daily)


@case(
    _QC.format(
        "negative_values_check", "negative_count",
        "SELECT ad_unit, count(*) FILTER (WHERE least(daily_impressions, desktop_impressions, mobile_impressions) < 0) AS n FROM x_daily GROUP BY 1",
    )
)
def qc_negative(b: Bound):
    return quality.qc_negative(b.daily)


@case(
    _QC.format(
        "date_continuity_check", "gap_count",
        f"SELECT ad_unit, count(*) FILTER (WHERE gap_days > 1) AS n FROM {_GAPS.format('x_raw')} GROUP BY 1",
    )
)
def qc_continuity(b: Bound):
    return quality.qc_continuity(b.raw)


@case(
    f"""SELECT 'holiday_join_check' AS check_name, h AS holiday_matches, n AS total_rows, {r('100.0 * h / n', 2)} AS match_rate_pct,
    CASE WHEN h > 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM (SELECT count(*) FILTER (WHERE is_holiday) AS h, count(*) AS n FROM x_daily)"""
)
def qc_holiday(b: Bound):
    return quality.qc_holiday(b.daily)


@case(
    f"""SELECT ad_unit, a AS actual_days, e AS expected_days, {r('100.0 * (e - a) / e', 2)} AS missing_pct, z AS zero_days,
    {r('100.0 * z / a', 2)} AS zero_pct, l AS low_traffic_days, lo AS min_impressions, hi AS max_impressions,
    {r('m', 0)} AS avg_impressions, {r('s', 0)} AS stddev_impressions, {r('s / nullif(m, 0)', 2)} AS cv,
    round(100.0 * (e - a) / e, 2) > 20 AS flag_missing, round(100.0 * z / a, 2) > 20 AS flag_zeros
    FROM (SELECT ad_unit, count(*) AS a, (DATE '2001-08-01' - DATE '1995-01-01') + 1 AS e,
    count(*) FILTER (WHERE daily_impressions = 0) AS z, count(*) FILTER (WHERE daily_impressions < 100) AS l,
    min(daily_impressions) AS lo, max(daily_impressions) AS hi, avg(daily_impressions) AS m,
    stddev_samp(daily_impressions) AS s FROM x_raw_gappy GROUP BY ad_unit)"""
)
def premodel_distribution(b: Bound):
    return quality.premodel_distribution(b.raw_gappy, GAPPY_START, GAPPY_END)


@case(f"SELECT * FROM {_GAPS.format('x_raw_gappy')} WHERE gap_days > 1")
def premodel_gaps(b: Bound):
    return quality.premodel_gaps(b.raw_gappy)


_STEPS = f"""(SELECT ad_unit, date, daily_impressions, {r('sb / nb', 0)} AS avg_before, {r('sa / na', 0)} AS avg_after,
    {r('(sa * nb) / (sb * na)', 2)} AS change_ratio, {r('(sb * na) / (sa * nb)', 2)} AS inverse_ratio FROM (
    SELECT ad_unit, date, daily_impressions, CAST(sum(daily_impressions) OVER b AS DOUBLE) AS sb, count(*) OVER b AS nb,
    CAST(sum(daily_impressions) OVER a AS DOUBLE) AS sa, count(*) OVER a AS na FROM x_daily_wide
    WINDOW b AS (PARTITION BY ad_unit ORDER BY date ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING),
    a AS (PARTITION BY ad_unit ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 30 FOLLOWING)) WHERE sb > 0 AND sa > 0
    AND greatest(round((sa * nb) / (sb * na), 2), round((sb * na) / (sa * nb), 2)) >= {{0}})"""


@case(f"SELECT * FROM {_STEPS.format('2.0')}")
def step_changes(b: Bound):
    return quality.step_changes(b.daily_wide)


@case(
    f"""SELECT ad_unit, count(*) AS shift_count, min(date) AS first_date, CASE WHEN arg_min(change_ratio, date) >= 1.5 THEN 'UP'
    ELSE 'DOWN' END AS direction FROM {_STEPS.format('1.5')} GROUP BY ad_unit"""
)
def step_summary(b: Bound):
    return quality.step_summary(quality.step_changes(b.daily_wide, threshold=1.5), 1.5)


_PREMODEL = f"""SELECT 'distribution' AS check, CASE WHEN bool_or(miss OR zero) THEN 'FAIL' ELSE 'PASS' END AS status FROM
    (SELECT round(100.0 * ({_ROWS_SPAN} - count(*)) / ({_ROWS_SPAN}), 2) > 20 AS miss,
     round(100.0 * count(*) FILTER (WHERE daily_impressions = 0) / count(*), 2) > 20 AS zero FROM x_daily_wide GROUP BY ad_unit)
    UNION ALL SELECT 'date_continuity', CASE WHEN bool_or(gap_days > 1) THEN 'FAIL' ELSE 'PASS' END FROM {_GAPS.format('x_daily_wide')}
    UNION ALL SELECT 'step_changes', CASE WHEN count(*) = 0 THEN 'PASS' ELSE 'FAIL' END FROM {_STEPS.format('2.0')}
    UNION ALL SELECT 'holiday_span', CASE WHEN max(holiday_date) >= DATE '2001-11-04' + 92 AND min(holiday_date) <= DATE '1995-01-02'
        THEN 'PASS' ELSE 'FAIL' END FROM x_hol"""


@case(_PREMODEL)
def premodel_checks(b: Bound):
    return quality.premodel_checks(b.daily_wide_kept, b.holidays, START, END, 92)


@case(
    f"""SELECT CASE WHEN p = t THEN 'PASS' ELSE 'REVIEW' END AS overall, p AS passed, t AS total, p || '/' || t AS summary
    FROM (SELECT count(*) FILTER (WHERE status = 'PASS') AS p, count(*) AS t FROM ({_PREMODEL}))"""
)
def summarize_checks(b: Bound):
    return quality.summarize_checks(quality.premodel_checks(b.daily_wide_kept, b.holidays, START, END, 92))
