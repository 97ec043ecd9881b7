import math
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.frames import daily, day, fold, forecast_frame
from tidecast.config import REGRESSOR, STRUCTURAL, ZERO_SHOT
from tidecast.functions.quantiles import exact_quantiles
from tidecast.functions.scalars import two_sided_probability
from tidecast.operators import metrics as m
from tidecast.operators import structural
from tidecast.operators.folds import in_fold
from tidecast.operators.regression import fit_xreg, forecast_with, forecast_xreg
from tidecast.operators.regression_ar import fit_xreg_ar, forecast_xreg_ar, solve
from tidecast.operators.routing import classify_volatility, route_models
from tidecast.operators.seasonal import forecast_zero_shot
from tidecast.plans.retrain import retrain
from tidecast.plans.walk_forward import fold_features, run_walk_forward
from tidecast.sources.holidays import holiday_dim


@pytest.fixture(scope="module")
def holidays(spark):
    return holiday_dim(spark, 2022, 2025)


def scored(spark, holidays, actuals, forecasts, train_days=30):
    """Train on 30 equal days (or a list), test on the given actuals."""
    train = [10] * train_days if isinstance(train_days, int) else train_days
    f = fold(len(train), len(actuals))
    df = daily(spark, {"A": train + actuals}, holidays)
    fc = forecast_frame(spark, [(len(train) + i, "A", *x) for i, x in enumerate(forecasts)])
    return m.forecast_metrics(fc, df, [f]).first()


def test_constant_series_has_no_mase(spark, holidays):
    got = scored(spark, holidays, [10, 20], [(11.0, 9.0, 12.0), (18.0, 19.0, 22.0)])
    assert got.mase is None and got.mae == 1.5 and got.coverage == 100.0
    assert got.mape == pytest.approx(10.0) and got.rmse == pytest.approx(math.sqrt(2.5))


def test_zero_actuals_and_missing_bounds(spark, holidays):
    got = scored(spark, holidays, [0, 20], [(4.0, None, None), (22.0, 1.0, 30.0)], [1, 3] * 15)
    assert got.mape == pytest.approx(10.0)  # the zero day drops out of MAPE only
    assert got.mae == 3.0 and got.coverage == 50.0 and got.mase == pytest.approx(1.5)
    assert scored(spark, holidays, [0, 0], [(4.0, 1.0, 5.0)] * 2).mape is None


def test_melt_keeps_nulls_and_compare_skips_them(spark, holidays):
    df = daily(spark, {"A": [10] * 32}, holidays)
    fc = forecast_frame(spark, [(30, "A", 11.0, 9.0, 12.0), (31, "A", 11.0, 9.0, 12.0)])
    long = m.melt_metrics(m.forecast_metrics(fc, df, [fold(30, 2)]), [fold(30, 2)])
    assert long.count() == 5 and long.where("metric_name = 'mase' and metric_value is null").count() == 1
    assert long.first().test_start == day(30)
    mase = m.compare_models(long).where("metric_name = 'mase'").first()
    assert mase.mean_value is None and mase.std_value is None


def test_even_count_median(spark):
    df = spark.createDataFrame([("m", "fold_1", "mape", float(v)) for v in (1, 2, 3, 4)],
                               "model_name string, fold_name string, metric_name string, metric_value double")
    assert m.compare_models(df).first().median_value == 2.0
    q = exact_quantiles(df, "metric_value", {"median": 0.5}, ["model_name"]).first()
    assert (q.n, q.median) == (4, 2.5)


@pytest.mark.parametrize("by", [["g"], []])
def test_quantiles_of_skewed_groups(spark, by):
    df = spark.range(60_000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 2)).alias("g"),
        F.pmod(F.hash("id"), F.lit(5000)).cast("double").alias("v"),
    )
    local = df.toPandas()
    names = {"q1": 0.25, "median": 0.5, "q3": 0.75}
    got = exact_quantiles(df, "v", names, by).collect()
    for row in got:
        part = local[local.g == row.g].v if by else local.v
        assert row.n == len(part)
        for name, q in names.items():
            assert row[name] == pytest.approx(np.quantile(part, q), abs=1e-9)
    assert len(got) == (3 if by else 1)


def test_quantiles_sort_no_more_than_the_brackets(spark):
    df = spark.range(50_000).select(F.lit("g").alias("g"), F.pmod(F.hash("id"), F.lit(1 << 30)).cast("double").alias("v"))
    got = exact_quantiles(df, "v", {"low": 0.01, "median": 0.5}, ["g"])
    values = df.toPandas().v
    row = got.first()
    assert (row.n, row.low, row.median) == (50_000, pytest.approx(np.quantile(values, 0.01)), pytest.approx(np.quantile(values, 0.5)))
    # Struct extremes sort all rows of a task before they are merged.
    assert "SortAggregate" not in got._jdf.queryExecution().executedPlan().toString()


def test_probability_approximation(spark):
    z = [-3.0, -1.96, 0.0, 0.5, 1.0, 2.5]
    df = spark.createDataFrame([(x,) for x in z], "z double").select("z", two_sided_probability(F.col("z")).alias("p"))
    for row in df.collect():
        assert row.p == pytest.approx(2 * NormalDist().cdf(abs(row.z)) - 1, abs=2e-7)


def test_zero_shot_repeats_the_week(spark, holidays):
    week = [10, 20, 30, 40, 50, 60, 70]
    f = fold(70, 14)
    train = in_fold(daily(spark, {"A": week * 10}, holidays), [f], "train")
    got = forecast_zero_shot(train, 14).orderBy("forecast_date").collect()
    assert [r.forecast_value for r in got] == [float(v) for v in week * 2]
    assert got[0].forecast_date == day(70) and got[0].forecast_lower == got[0].forecast_value
    short = in_fold(daily(spark, {"A": [4, 6]}, holidays), [fold(2, 3)], "train")
    assert {r.forecast_value for r in forecast_zero_shot(short, 3).collect()} == {5.0}


def test_regression_equals_least_squares(spark, holidays):
    rng = np.random.default_rng(3)
    df = daily(spark, {"A": [int(v) for v in rng.integers(50, 500, 400)]}, holidays)
    train = in_fold(df, [fold(400, 1)], "train")
    got = fit_xreg(train).first()
    local = train.orderBy("date").toPandas()
    x = np.column_stack([
        np.ones(400), local.day_of_week, local.is_weekend.astype(int), local.is_holiday.astype(int),
        local.days_to_next_holiday.fillna(0),
    ]).astype(float)
    beta, *_ = np.linalg.lstsq(x, local.daily_impressions.astype(float), rcond=None)
    assert got.intercept == pytest.approx(beta[0]) and list(got.coefficients) == pytest.approx(list(beta[1:]))
    resid = local.daily_impressions - x @ beta
    assert got.sigma == pytest.approx(math.sqrt((resid**2).sum() / 395))


def test_regression_without_variation(spark, holidays):
    """No holiday in the sample: its column is constant and gets no weight."""
    df = daily(spark, {"A": [None] * 20 + [5, 7, 6, 8, 5, 9, 4]}, holidays)
    f = fold(27, 5)
    params = fit_xreg(in_fold(df, [f], "train"))
    assert params.first().coefficients[2] == 0.0
    assert forecast_xreg(params, fold_features(df, holidays, [f])).count() == 5


def test_regression_with_lasting_errors(spark, holidays):
    """Planted coefficients and phi are recovered; bounds start narrow and widen to the errors' own spread."""
    rng, n = np.random.default_rng(8), 700
    plain = daily(spark, {"A": [1] * n, "B": [5] * n, "C": [9] + [None] * (n - 1)}, holidays)
    local = plain.filter("ad_unit = 'A'").orderBy("date").toPandas()
    e = np.zeros(n)
    for t in range(1, n):
        e[t] = 0.8 * e[t - 1] + rng.normal(0, 20)
    y = np.round(1000 + 30 * local.day_of_week + 200 * local.is_holiday.astype(int) + e).astype(int).tolist()
    df = daily(spark, {"A": y, "B": [5] * n, "C": [9] + [None] * (n - 1)}, holidays)
    f = fold(n, 10)
    params = fit_xreg_ar(in_fold(df, [f], "train"))
    got = {r.ad_unit: r for r in params.collect()}
    assert got["A"].phi == pytest.approx(0.8, abs=0.06) and got["A"].sigma == pytest.approx(20, rel=0.1)
    assert got["A"].coefficients[0] == pytest.approx(30, abs=3) and got["A"].coefficients[2] == pytest.approx(200, abs=25)
    assert got["B"].intercept == 5.0 and got["B"].phi == 0.0 and got["B"].sigma == 0.0 and got["C"].intercept == 9.0
    # a fixed point: least squares of the quasi-differences by another way, and the slope of its residuals
    x = np.column_stack([np.ones(n), local.day_of_week, local.is_weekend.astype(int), local.is_holiday.astype(int), local.days_to_next_holiday.fillna(0)]).astype(float)
    phi, y = got["A"].phi, np.array(y, dtype=float)
    beta, *_ = np.linalg.lstsq(x[1:] - phi * x[:-1], y[1:] - phi * y[:-1], rcond=None)
    rest = y - x @ beta
    assert [got["A"].intercept, *got["A"].coefficients] == pytest.approx(beta.tolist(), rel=1e-6)
    assert (rest[1:] @ rest[:-1]) / (rest[:-1] @ rest[:-1]) == pytest.approx(phi, abs=1e-4) and got["A"].last_e == pytest.approx(rest[-1], rel=1e-6)
    rows = forecast_xreg_ar(params, fold_features(df, holidays, [f])).filter("ad_unit = 'A'").orderBy("forecast_date").collect()
    half = [r.forecast_upper - r.forecast_value for r in rows]
    assert half[0] == pytest.approx(1.959964 * got["A"].sigma, rel=1e-6) and half == sorted(half) and half[-1] < 1.96 * got["A"].sigma / 0.58
    later = np.array([r.forecast_value for r in rows])
    assert abs(later[0] - y[-1]) < 400 and len(rows) == 10


def test_solve_leaves_mixed_columns_out():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(50, 3))
    x = np.column_stack([x, x[:, 0] + x[:, 1]])
    y = x @ np.array([1.0, 2.0, 3.0, 0.0])
    beta, used = solve(x.T @ x, x.T @ y)
    assert used == 3 and beta == pytest.approx([1, 2, 3, 0])


def wave(n, step_at=None, spike_at=None):
    out = []
    for i in range(n):
        v = 1000 + i // 4 + (200 if i % 7 in (0, 6) else 0) + (i * 37 % 11)
        if step_at is not None and i >= step_at:
            v += 2500
        if i == spike_at:
            v += 5000
        out.append(v)
    return out


def test_structural_parts(spark, holidays):
    f = fold(500, 92)
    df = daily(spark, {"plain": wave(592), "step": wave(592, step_at=250), "spike": wave(592, spike_at=300)}, holidays)
    params = structural.fit_structural(in_fold(df, [f], "train"), holidays)
    kept = {r.ad_unit: r for r in params.collect()}
    assert kept["step"].has_step_changes and not kept["plain"].has_step_changes
    assert kept["spike"].has_spikes_and_dips and kept["plain"].has_yearly
    assert kept["step"].level == pytest.approx(2500, rel=0.1)
    explained = structural.explain_forecast(params, holidays)
    parts = ["trend", "seasonal_period_weekly", "seasonal_period_yearly", "holiday_effect", "spikes_and_dips",
             "step_changes", "residual"]
    total = sum((F.coalesce(F.col(p), F.lit(0.0)) for p in parts), F.lit(0.0))
    assert explained.where(F.abs(total - F.col("forecast_value")) > 1e-6).count() == 0
    assert explained.count() == 3 * 92
    fc = structural.forecast_structural(params, holidays)
    mape = {r.ad_unit: r.mape for r in m.forecast_metrics(fc, df, [f]).collect()}
    assert mape["plain"] < 5
    hits = structural.detect_anomalies(in_fold(df, [f], "train"), holidays).where("is_anomaly")
    assert ("spike", day(300)) in {(r.ad_unit, r.date) for r in hits.collect()}


def test_structural_degenerate_series(spark, holidays):
    f = fold(40, 5)
    df = daily(spark, {"const": [7] * 40, "zero": [0] * 40, "one": [5], "few": [1, 2, 3]}, holidays)
    train = in_fold(df, [f], "train")
    params = structural.fit_structural(train, holidays)
    got = structural.forecast_structural(params, holidays, 5)
    assert got.count() == 20
    assert got.where("isnan(forecast_value) or forecast_value is null").count() == 0
    const = got.where("ad_unit = 'const'").collect()
    assert all(r.forecast_value == pytest.approx(7.0, abs=1e-3) for r in const)
    found = structural.detect_anomalies(train, holidays)
    assert found.count() == 84 and found.where("is_anomaly").count() == 0


def test_filters_on_derived_columns_stay_cheap(spark, holidays):
    """A filter must not be copied down through the derivation."""
    train = in_fold(daily(spark, {"A": wave(100)}, holidays), [fold(100, 5)], "train")
    hits = structural.detect_anomalies(train, holidays).where("anomaly_probability >= 0.9 or is_anomaly")
    assert len(hits._jdf.queryExecution().optimizedPlan().toString()) < 200_000
    shown = fit_xreg(train).where("sigma > 0 and intercept > 0")
    assert len(shown._jdf.queryExecution().optimizedPlan().toString()) < 200_000


def test_one_shuffle_per_fit(spark, holidays, tmp_path):
    path = str(tmp_path / "daily")
    daily(spark, {"A": wave(60)}, holidays).write.parquet(path)
    train = in_fold(spark.read.parquet(path), [fold(60, 5)], "train")
    for made in (
        structural.fit_structural(train, holidays),
        structural.detect_anomalies(train, holidays),
        forecast_zero_shot(train),
        fit_xreg(train),
    ):
        plan = made._jdf.queryExecution().executedPlan().toString()
        data = [line for line in plan.split("\n") if "Exchange hashpartitioning(fold_name" in line]
        assert len(data) == 1, plan
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_own_model_hook(spark, holidays):
    train = in_fold(daily(spark, {"A": [1, 2], "B": [3]}, holidays), [fold(2, 1)], "train")

    def total(pdf):
        return pdf.groupby("ad_unit", as_index=False).agg(total=("daily_impressions", "sum"))

    got = forecast_with(train, total, "ad_unit string, total long")
    assert {tuple(r) for r in got.collect()} == {("A", 3), ("B", 3)}


def test_walk_forward_row_counts(spark, holidays):
    f1, f2 = fold(400, 92), fold(492, 92, "fold_2")
    df = daily(spark, {u: wave(584 + i)[i:] for i, u in enumerate("ABC")}, holidays)
    run = run_walk_forward(df, holidays, [f1, f2])
    assert run.forecasts.count() == 3 * 92 * 2 * 3  # series x days x folds x models
    assert run.metrics.count() == 3 * 2 * 3 * 5
    assert run.comparison.count() == 3 * 5 * 3
    assert run.impact.count() == 3 * 3 * 2
    ranking = m.model_ranking(run.comparison, run.impact).collect()
    assert {r.model_name for r in ranking} == {ZERO_SHOT, STRUCTURAL, REGRESSOR}
    assert sorted(r.rank for r in ranking) == [1, 2, 3]
    some = run_walk_forward(df, holidays, [f1], models=(ZERO_SHOT,))
    assert some.metrics is None and some.forecasts.count() == 3 * 92


def test_retrain_gate(spark, holidays):
    df = daily(spark, {"A": wave(592)}, holidays)
    assert retrain(df, holidays, day(591), days=580).first().status == "PROMOTED"
    assert retrain(df, holidays, day(591), days=580, gate=1e-6).first().status == "REJECTED"
    assert retrain(df.where(F.lit(False)), holidays, day(591)).first().status == "REJECTED"


def test_routing(spark, holidays):
    df = daily(spark, {"new": [10] * 89, "steady": [10, 11] * 50, "wild": [1, 100] * 50}, holidays)
    assert {r.ad_unit: r.model_name for r in route_models(df).collect()} == {
        "new": ZERO_SHOT, "steady": REGRESSOR, "wild": ZERO_SHOT,
    }
    assert route_models(df, need_explain=True).where("ad_unit = 'steady'").first().model_name == STRUCTURAL
    cv = spark.createDataFrame([("a", 0.29), ("b", 0.3), ("c", 0.5), ("d", 0.51), ("e", None)], "ad_unit string, cv double")
    got = {r.ad_unit: (r.content_type, r.volatility_tier, r.high_volatility) for r in classify_volatility(cv).collect()}
    assert got == {
        "a": ("stable", "regressor_eligible", False), "b": ("stable", "moderate", False),
        "c": ("event_driven", "event_driven", False), "d": ("event_driven", "event_driven", True),
        "e": (None, None, False),
    }


def test_one_huge_day_leaves_later_days_alone(spark, holidays):
    values = [10 + k % 3 for k in range(300)]
    values[150] = 10**10
    train = in_fold(daily(spark, {"A": values}, holidays), [fold(300, 14)], "train")
    rows = structural.decompose_history(train, holidays).where("spike <> 0").collect()
    assert [r.t for r in rows] == [150]
