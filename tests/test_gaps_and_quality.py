from datetime import date

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.frames import daily, day, volumes
from tidecast.operators import gaps, quality
from tidecast.operators.calendar import next_holiday, with_holidays
from tidecast.plans.daily_load import complete_daily
from tidecast.sources.holidays import holiday_dim


@pytest.fixture(scope="module")
def holidays(spark):
    return holiday_dim(spark, 2022, 2025)


def filled(spark, values, end=None):
    df = volumes(spark, {"A": values})
    got = gaps.gap_fills(df, day(0), day(end if end is not None else len(values) - 1))
    return {(r.date - day(0)).days: r.daily_impressions for r in got.collect()}


def test_midpoints(spark):
    assert filled(spark, [10, None, 20]) == {1: 15}
    assert filled(spark, [10, None, 11]) == {1: 11}  # half goes up
    assert filled(spark, [10, None, None, None, 20]) == {1: 15, 2: 15, 3: 15}


def test_edges_stay_absent(spark):
    assert filled(spark, [None, None, 10, 20, None]) == {}
    # A neighbour outside the range does not count.
    assert filled(spark, [10, None, None, 20], end=2) == {}


def brute_force(values):
    out = {}
    for i, v in enumerate(values):
        before = [x for x in values[:i] if x is not None]
        after = [x for x in values[i + 1 :] if x is not None]
        if v is None and before and after:
            out[i] = (before[-1] + after[0] + 1) // 2
    return out


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.one_of(st.none(), st.integers(0, 1000)), min_size=1, max_size=25))
def test_fills_equal_brute_force(spark, values):
    assert filled(spark, values) == brute_force(values)


def test_backfill_is_idempotent_and_keeps_rows(spark, holidays):
    df = daily(spark, {"A": [3, None, 9, None, None, 4], "B": [1, 2, 3]}, holidays)
    once = gaps.backfill_gaps(df, holidays, day(0), day(5))
    twice = gaps.backfill_gaps(once, holidays, day(0), day(5))
    assert once.columns == df.columns
    assert once.exceptAll(twice).count() == 0 and twice.exceptAll(once).count() == 0
    assert df.exceptAll(once).count() == 0
    assert quality.check_continuity(once).first().status == "PASS"
    assert quality.check_continuity(df).first().gap_count == 2
    raw = df.select("date", "ad_unit", *gaps.VOLUMES)
    together = complete_daily(raw, holidays, day(0), day(5))
    assert together.exceptAll(once).count() == 0 and once.exceptAll(together).count() == 0


def test_table_checks(spark, holidays):
    df = daily(spark, {"A": [3, 4, 9]}, holidays)
    assert quality.check_row_count(df, 3).first().status == "PASS"
    assert quality.check_row_count(df, 4).first().status == "FAIL"
    assert quality.check_no_nulls(df, ["date", "holiday_name"]).first().null_count == 2
    assert quality.check_holiday_join(df).first().status == "PASS"  # January 1 is a holiday
    broken = df.withColumn("days_to_next_holiday", F.lit(3).cast("bigint"))
    assert quality.check_holiday_join(broken).first().edge_case_violations == 1
    assert quality.check_row_rules(df).first().status == "PASS"
    assert quality.check_row_rules(df.withColumn("quarter", F.lit(5))).first().quarter_violations == 3
    summary = quality.summarize_checks(quality.validate_daily(df, 100)).first()
    assert (summary.overall, summary.summary) == ("REVIEW", "3/4")


def test_empty_input_fails_without_error(spark, holidays):
    empty = daily(spark, {"A": [1]}, holidays).where(F.lit(False))
    assert [r.status for r in quality.validate_daily(empty, 1).orderBy("check").collect()] == [
        "PASS", "FAIL", "PASS", "FAIL",
    ]
    assert quality.step_changes(empty).count() == 0
    assert quality.check_holiday_span(holidays.where(F.lit(False)), day(0), day(1), 1).first().status == "FAIL"


def test_series_checks_report_passing_series(spark):
    df = volumes(spark, {"A": [1, -2], "B": [1, 2]})
    assert {(r.ad_unit, r.negative_count, r.status) for r in quality.qc_negative(df).collect()} == {
        ("A", 1, "FAIL"),
        ("B", 0, "PASS"),
    }
    assert {r.status for r in quality.qc_row_count(df, day(0), day(1)).collect()} == {"PASS"}


def test_step_series(spark):
    df = volumes(spark, {"up": [10] * 60 + [30] * 60, "flat": [10] * 120})
    steps = quality.step_changes(df)
    assert {r.ad_unit for r in steps.collect()} == {"up"}
    got = quality.step_summary(steps).first()
    assert (got.ad_unit, got.direction) == ("up", "UP")
    assert abs((got.first_date - day(60)).days) <= 30


def test_finite_metrics(spark):
    rows = [("fold_1", "mase", None), ("fold_1", "mape", float("nan")), ("fold_1", "mae", float("inf")),
            ("fold_1", "rmse", None), ("fold_2", "mape", None)]
    df = spark.createDataFrame(rows, "fold_name string, metric_name string, metric_value double")
    assert quality.check_finite(df, "fold_1").first().invalid_count == 3


def test_coverage_counts(spark):
    df = spark.createDataFrame(
        [("fold_1", "m1", "A"), ("fold_1", "m1", "B"), ("fold_1", "m2", "A"), ("fold_2", "m3", "C")],
        "fold_name string, model_name string, ad_unit string",
    )
    got = quality.check_forecast_coverage(df, "fold_1", 2, 2).first()
    assert (got.status, got.model_count, got.ad_unit_count, got.total_rows) == ("PASS", 2, 2, 3)
    none = quality.check_forecast_coverage(df, "fold_9", 2, 2).first()
    assert (none.status, none.model_count, none.total_rows) == ("FAIL", 0, 0)


def test_premodel_distribution_flags(spark):
    df = volumes(spark, {"zeros": [0, 0, 5, 5], "short": [500]})
    got = {r.ad_unit: r for r in quality.premodel_distribution(df, day(0), day(3)).collect()}
    assert (got["zeros"].zero_pct, got["zeros"].flag_zeros, got["zeros"].low_traffic_days) == (50.0, True, 4)
    assert (got["short"].missing_pct, got["short"].flag_missing, got["short"].cv) == (75.0, True, None)


def test_days_before_the_first_holiday_and_two_names_on_a_date(spark):
    listed = [("1899-12-25", "Yule"), ("1900-01-01", "New Year"), ("1900-01-01", "Founding")]
    hol = spark.createDataFrame(listed, "d string, holiday_name string").selectExpr("cast(d as date) holiday_date", "holiday_name")
    days = spark.createDataFrame([("1899-12-20",), ("1899-12-25",), ("1900-01-01",), ("1900-01-02",)], "d string").selectExpr("cast(d as date) date")
    got = sorted((str(r.date), r.is_holiday, r.holiday_name or "", r.days_to_next_holiday) for r in with_holidays(days, hol).collect())
    assert got == [
        ("1899-12-20", False, "", 5),
        ("1899-12-25", True, "Yule", 0),
        ("1900-01-01", True, "Founding", 0),
        ("1900-01-01", True, "New Year", 0),
        ("1900-01-02", False, "", None),
    ]
    assert sorted(r.days_to_next_holiday for r in next_holiday(days, hol).collect() if r.next_holiday) == [0, 0, 5]
