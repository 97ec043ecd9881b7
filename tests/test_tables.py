"""Sources, sinks, holidays and calendar rules."""

from datetime import date

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.sql import functions as F

from tests.frames import day, volumes
from tidecast.config import DEFAULT_FOLDS, Fold, check_horizon, expanding_folds, resolve_fold
from tidecast.operators import calendar as cal
from tidecast.operators.rollup import daily_rollup, extract_hourly
from tidecast.plans.daily_load import run_load
from tidecast.schemas import LAYOUT, SCHEMAS
from tidecast.sources import tables
from tidecast.sources.holidays import holiday_dim, holidays_in_range


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def test_holidays_of_known_years(spark):
    by_date = {r.holiday_date: (r.holiday_name, r.is_major) for r in holiday_dim(spark, 1999, 2025).collect()}
    assert by_date[date(2024, 3, 31)] == ("Easter Sunday", True)
    assert by_date[date(2023, 4, 9)] == ("Easter Sunday", True)
    assert by_date[date(2024, 5, 27)] == ("Memorial Day", True)
    assert by_date[date(2024, 11, 28)] == ("Thanksgiving Day", True)
    assert by_date[date(2024, 12, 2)] == ("Cyber Monday", True)
    assert by_date[date(2024, 2, 11)] == ("Super Bowl Sunday", True)
    # Two on one date: the later rule names it, and the date stays unique.
    assert by_date[date(2022, 6, 19)] == ("Juneteenth", False)
    assert by_date[date(1999, 2, 14)] == ("Valentine's Day", False)
    assert sum(d.year == 2024 for d in by_date) == 21
    assert sum(d.year == 2022 for d in by_date) == 20


def test_holidays_in_range_reads_text_flags(spark):
    text = holiday_dim(spark, 2023, 2023).withColumn("is_major", F.initcap(F.col("is_major").cast("string")))
    got = holidays_in_range(text, "2023-02-01", "2023-02-28")
    assert {(r.holiday_name, r.is_major) for r in got.collect()} == {
        ("Super Bowl Sunday", True),
        ("Valentine's Day", False),
        ("Presidents Day", False),
    }


def test_week_zero_and_weekdays(spark):
    df = spark.createDataFrame([(date(2023, 1, 1),), (date(2022, 1, 1),), (date(2024, 12, 31),)], "date date")
    got = {r.date: r for r in cal.with_calendar(df).collect()}
    assert (got[date(2023, 1, 1)].week_of_year, got[date(2023, 1, 1)].day_of_week) == (1, 1)
    assert (got[date(2022, 1, 1)].week_of_year, got[date(2022, 1, 1)].is_weekend) == (0, True)
    assert (got[date(2024, 12, 31)].week_of_year, got[date(2024, 12, 31)].quarter) == (52, 4)


def test_next_holiday_edges(spark):
    hol = holiday_dim(spark, 2023, 2023)
    df = spark.createDataFrame(
        [(date(1950, 1, 1),), (date(2023, 12, 25),), (date(2023, 12, 26),), (date(2024, 1, 1),)], "date date"
    )
    got = {r.date: (r.is_holiday, r.holiday_name, r.days_to_next_holiday) for r in cal.with_features(df, hol).collect()}
    assert got[date(2023, 12, 25)] == (True, "Christmas Day", 0)
    assert got[date(2023, 12, 26)] == (False, None, 5)
    assert got[date(2024, 1, 1)] == (False, None, None)  # after the last holiday
    assert got[date(1950, 1, 1)] == (False, None, (date(2023, 1, 1) - date(1950, 1, 1)).days)
    assert cal.xreg_features(cal.with_features(df, hol)).where("days_to_next_holiday is null").count() == 0


def test_extract_and_rollup(spark):
    hourly = spark.createDataFrame(
        [
            ("2023-01-01 00:00:00", "en", "A", 5),
            ("2023-01-01 23:59:59", "en.m", "A", 7),
            ("2023-01-02 00:00:00", "en", "A", 1),
            ("2023-01-01 10:00:00", "de", "A", 100),
            ("2023-01-01 10:00:00", "en", "B", 100),
        ],
        "datehour string, wiki string, title string, views long",
    ).withColumn("datehour", F.to_timestamp("datehour"))
    got = daily_rollup(extract_hourly([hourly], "2023-01-01", "2023-01-01", ["A"]))
    assert rows(got.select("date", "ad_unit", "daily_impressions", "desktop_impressions", "mobile_impressions")) == [
        (date(2023, 1, 1), "A", 12, 5, 7)
    ]


def test_filters_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "hourly")
    spark.sql(
        "select timestamp'2023-01-01 00:00:00' as datehour, 'en' as wiki, 'A' as title, 1L as views, 'x' as unused"
    ).write.parquet(path)
    got = extract_hourly([spark.read.parquet(path)], "2023-01-01", "2023-12-31", ["A"])
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = got._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    pushed = plan[plan.index("PushedFilters") :]
    for part in ("GreaterThanOrEqual(datehour", "LessThan(datehour", "EqualTo(title,A)", "In(wiki, [en,en.m])"):
        assert part in pushed
    assert "unused" not in plan[plan.index("ReadSchema") :]


def test_replace_scope_clears_empty_partitions(spark, tmp_path):
    path = str(tmp_path / "forecasts")
    both = spark.createDataFrame([("fold_1", "a", 1), ("fold_1", "b", 2), ("fold_2", "a", 3)], "fold_name string, model_name string, v int")
    keys = ["fold_name", "model_name"]
    tables.replace_scope(both, path, keys, F.lit(True))
    fresh = spark.createDataFrame([("fold_1", "a", 10), ("fold_2", "a", 99)], both.schema)
    tables.replace_scope(fresh, path, keys, F.col("fold_name") == "fold_1")
    got = spark.read.schema(both.schema).parquet(path)
    # b of fold_1 is gone, fold_2 is untouched although the new frame mentions it.
    assert sorted(tuple(r) for r in got.select("fold_name", "model_name", "v").collect()) == [
        ("fold_1", "a", 10),
        ("fold_2", "a", 3),
    ]
    tables.replace_scope(got, path, keys, F.col("fold_name") == "fold_2")  # from the same table
    assert spark.read.schema(both.schema).parquet(path).count() == 2


def test_replace_scope_of_keys_that_need_escapes(spark, tmp_path):
    path = str(tmp_path / "odd")
    odd = ["a:b", "x/y%=#?*'", None, "plain"]
    rows = spark.createDataFrame([(k, n) for n, k in enumerate(odd)], "k string, v int")
    tables.replace_scope(rows, path, ["k"], F.lit(True))
    gone = F.col("k").isNull() | F.col("k").contains(":") | F.col("k").contains("/")
    tables.replace_scope(rows.where(F.lit(False)), path, ["k"], gone)
    got = spark.read.schema("k string, v int").parquet(path).select("k", "v").collect()
    assert [tuple(r) for r in got] == [("plain", 3)]


def test_replace_table_keeps_declared_layout(spark, tmp_path):
    path = str(tmp_path / "raw")
    raw = volumes(spark, {"A": [1, 2], "B": [3, 4]}).withColumn("wiki", F.lit("en"))
    for _ in range(2):  # idempotent
        tables.replace_table(raw, path, "raw_pageviews")
    got = tables.read_table(spark, path, "raw_pageviews")
    assert got.columns == SCHEMAS["raw_pageviews"].names and got.count() == 4
    assert (tmp_path / "raw" / "date=2023-01-01").is_dir()
    tables.append_table(raw, path, "raw_pageviews")
    assert tables.read_table(spark, path, "raw_pageviews").count() == 8
    assert set(LAYOUT) <= set(SCHEMAS)


def test_csv_round_trip_and_bad_row(spark, tmp_path):
    path = str(tmp_path / "holidays")
    hol = holiday_dim(spark, 2024, 2024)
    tables.export_csv(hol, path)
    back = tables.load_csv(spark, path, SCHEMAS["us_holidays"])
    assert rows(back, "holiday_date") == rows(hol, "holiday_date")
    bad = tmp_path / "bad.csv"
    bad.write_text("holiday_date,holiday_name,is_major\nnot-a-date,X,true\n")
    with pytest.raises(Py4JJavaError, match="MALFORMED_RECORD"):
        tables.load_csv(spark, str(bad), SCHEMAS["us_holidays"]).collect()


def test_ctas_replaces(spark):
    for n in (3, 2):
        assert tables.ctas(spark.range(n), "tidecast_ctas").count() == n
    spark.sql("DROP TABLE tidecast_ctas")


def test_insert_missing_changes_no_existing_row(spark):
    target = spark.createDataFrame([(1, "old")], "k int, v string")
    source = spark.createDataFrame([(1, "new"), (2, "new")], "k int, v string")
    assert rows(tables.insert_missing(target, source, ["k"]), "k") == [(1, "old"), (2, "new")]
    assert rows(tables.extend_dimension(target, source, "k"), "k") == [(1, "old"), (2, "new")]


def test_recent_and_parameters(spark):
    df = volumes(spark, {"A": [1] * 10})
    assert tables.recent(df, 3, day(9)).count() == 4
    assert tables.date_filter(df).count() == 10
    assert tables.date_filter(df, end=day(1)).count() == 2
    got = tables.run_sql(
        spark, "SELECT count(*) AS n FROM {t} WHERE array_contains(:u, ad_unit)", {"u": ["x' OR '1'='1"]}, t=df
    )
    assert got.first().n == 0
    assert next(tables.to_rows(got)) == {"n": 0}


def test_folds():
    assert check_horizon(DEFAULT_FOLDS)
    with pytest.raises(ValueError):
        check_horizon([Fold.of("f", "2023-01-01", "2023-01-31", "2023-02-01", "2023-02-02")])
    made = expanding_folds(date(2023, 1, 1), date(2024, 7, 1), 2)
    assert made == DEFAULT_FOLDS
    assert resolve_fold("cross_fold_avg") == "fold_2" and resolve_fold("fold_1") == "fold_1"


def test_load_stores_and_validates(spark, tmp_path):
    hourly = volumes(spark, {"A": [3, None, 5, 6], "B": [1, 2, 3, 4]}).select(
        F.col("date").cast("timestamp").alias("datehour"), F.lit("en").alias("wiki"), F.col("ad_unit").alias("title"), F.col("daily_impressions").alias("views")
    )
    hol = holiday_dim(spark, 2023, 2023)
    checks = run_load([hourly], hol, day(0), day(3), str(tmp_path), 8)
    assert {r.status for r in checks.collect()} == {"PASS"} and checks.count() == 4
    daily = tables.read_table(spark, str(tmp_path / "daily_impressions"), "daily_impressions")
    assert rows(daily.where("ad_unit = 'A'").select("date", "daily_impressions"), "date") == [(day(0), 3), (day(1), 4), (day(2), 5), (day(3), 6)]
    assert (tmp_path / "daily_impressions" / "date=2023-01-02").is_dir()
    again = run_load([hourly], hol, day(0), day(3), str(tmp_path), 9, partitions=[])  # replaces, and a day is missing
    assert {r.check: r.status for r in again.collect()}["row_count"] == "FAIL"
    assert not (tmp_path / "daily_impressions" / "date=2023-01-02").exists() and daily.sparkSession.read.parquet(str(tmp_path / "raw_pageviews")).count() == 7
