import pytest
from pyspark.sql import functions as F

from checks.bindings import Bound
from checks.compare import compare, connect
from tests.frames import day, volumes
from tidecast.operators import anomalies as an
from tidecast.operators import decomposition as dec
from tidecast.operators import events as ev
from tidecast.operators import explore
from tidecast.operators import serving as sv
from tidecast.sources import registry

SF = "/root/testdata/sf0.001"

QUICK = [
    "daily_rollup_clock_times", "build_daily_features", "backfill_gaps", "next_holiday_of_dates", "premodel_gaps",
    "check_holiday_join", "distribution_balance", "weekend_pattern", "trend_summary", "forecast_zero_shot_wide",
    "forecast_metrics", "match_terms", "anomaly_rate", "component_stats", "model_ranking",
]


@pytest.mark.parametrize("name", QUICK)
def test_query_equals_sql(spark, name):
    assert compare(spark, connect(SF), name, SF).startswith("match")


def test_every_query_reads_the_tables():
    import __spark_entry__ as contract
    from checks.registry import ORACLES, QUERIES

    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert set(QUERIES) == set(ORACLES)


def points(spark, rows):
    return spark.createDataFrame(
        [(day(i), u, "fold_1", float(y), True, 10.0, 20.0, p) for i, u, y, p in rows],
        "date date, ad_unit string, fold_name string, daily_impressions double, is_anomaly boolean, "
        "lower_bound double, upper_bound double, anomaly_probability double",
    )


def test_anomaly_types_and_order(spark):
    df = points(spark, [(0, "A", 30, 0.99), (1, "A", 5, 0.97), (2, "A", 15, 0.96)])
    got = an.explore_top(df, 2).collect()
    assert [(r.anomaly_type, r.deviation_ratio) for r in got] == [("HIGH_SPIKE", 3.0), ("LOW_DIP", -2.0)]


def test_large_groups_are_whole_rows(spark):
    df = points(spark, [(0, f"u{i:04d}", 30, 0.95 + i * 1e-6) for i in range(500)] + [(1, u, 30, 0.99) for u in "abc"])
    rows = an.anomalies_by_date(df).orderBy(F.desc("probability"), "affected_article").collect()
    assert [r.affected_article for r in rows if r.date == day(1)] == ["a", "b", "c"]
    hot = [r for r in rows if r.date == day(0)]
    assert [r.affected_article for r in hot] == [f"u{i:04d}" for i in reversed(range(500))]
    assert all(r.articles_affected == 500 for r in hot)


def test_last_event_of_a_date_is_the_label(spark):
    df = points(spark, [(0, "a", 30, 0.99)])
    events = ev.event_table(spark, {"a": [(str(day(0)), "first", "Seasonal"), (str(day(0)), "second", "Seasonal")]})
    assert [r.label for r in ev.annotate_anomalies(df, events).collect()] == ["second"]
    assert ev.label_events(df, events, ev.guidance_table(spark)).count() == 2


def test_events(spark):
    df = points(spark, [(0, "NFL", 30, 0.99), (42, "NFL", 30, 0.99), (0, "x", 30, 0.97)])
    events = ev.event_table(spark, registry.EVENTS)
    got = {(r.ad_unit, r.date): r for r in ev.label_events(df, events, ev.guidance_table(spark)).collect()}
    assert got["NFL", day(42)].category == "Sports Event"
    assert got["NFL", day(42)].forecastability == "Add custom holiday regressors for game days"
    assert (got["x", day(0)].event, got["x", day(0)].forecastability) == ("", "")
    assert {r.label for r in ev.annotate_anomalies(df, events).collect()} == {"Anomaly", "Super Bowl LVII (Chiefs vs Eagles)"}
    summary = ev.anomaly_summary(df, events).first()
    assert (summary.total_anomalies, summary.matched_events) == (3, 1)
    assert ev.vertical_table(spark, registry.VERTICALS).count() == 34
    assert ev.anomaly_summary(df, ev.event_table(spark, {})).first().matched_events == 0


def test_hypotheses_cover_published_patterns():
    assert set(registry.EXPECTED_PATTERNS.values()) == set(dec.HYPOTHESES)


def test_match_terms_spellings(spark):
    units = spark.createDataFrame([("Taylor_Swift",), ("NFL",), ("Sleep",)], "ad_unit string")
    terms = spark.createDataFrame([("taylor swift",), ("nfl",), ("x",)], "term string")
    assert {r.ad_unit: r.found for r in explore.match_terms(units, terms).collect()} == {
        "Taylor_Swift": True, "NFL": True, "Sleep": False,
    }


def test_clip_horizon_is_inclusive(spark):
    df = volumes(spark, {"A": [1] * 60}).withColumnRenamed("date", "forecast_date")
    assert sv.clip_horizon(df, 30).count() == 31


def test_metric_matrix_picks_best(spark):
    rows = [("a", "mape", 1.0), ("b", "mape", 2.0), ("a", "coverage", 80.0), ("b", "coverage", 90.0)]
    df = spark.createDataFrame([(m, "cross_fold_avg", n, v) for m, n, v in rows],
                               "model_name string, fold_name string, metric_name string, mean_value double")
    got = {r.model_name: r for r in sv.metric_matrix(df).collect()}
    assert got["a"].best_mape and not got["a"].best_coverage and got["b"].best_coverage
    assert got["a"].rmse is None and not got["a"].best_rmse


def test_balance_of_zero_traffic(spark):
    df = volumes(spark, {"A": [0], "B": [5], "C": [9]}).withColumn("wiki", F.lit("en"))
    got = explore.distribution_balance(explore.distribution_stats(df)).first()
    assert got.max_min_ratio == float("inf") and (got.max_ad_unit, got.min_ad_unit) == ("C", "A")
    assert (got.high_traffic_units, got.low_traffic_units) == (1, 2)


def test_no_cross_joins_in_any_plan(spark):
    """Spot check of the joins that could become one."""
    b = Bound(spark, SF)
    frames = [b.daily, explore.traffic_sides(explore.distribution_stats(b.raw)), b.anomalies]
    frames.append(dec.annotate_holidays(b.decomposition, b.holidays, "A", "fold_1"))
    for df in frames:
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan
