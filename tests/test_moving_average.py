import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.frames import daily, fold
from tidecast.operators import moving_average as ma
from tidecast.operators.folds import in_fold
from tidecast.operators.structural import decompose_history
from tidecast.sources.holidays import holiday_dim

DAYS = 700


@pytest.fixture(scope="module")
def holidays(spark):
    return holiday_dim(spark, 2022, 2025)


def noise(seed, n=DAYS):
    return np.random.default_rng(seed).normal(0, 100, n + 1)


def ar(phi, u):
    out = [0.0]
    for x in u[1:]:
        out.append(phi * out[-1] + x)
    return np.array(out[1:])


@pytest.fixture(scope="module")
def train(spark, holidays):
    u, v, w = noise(1), noise(2), noise(3)
    series = {
        "up": 5000 + u[1:] + 0.7 * u[:-1],
        "down": 5000 + v[1:] - 0.5 * v[:-1],
        "fading": 5000 + ar(0.7, w),
        "constant": np.full(60, 7.0),
        "few": np.array([1.0, 5.0, 2.0, 9.0]),
        "one": np.array([5.0]),
    }
    made = daily(spark, {k: [int(round(x)) for x in s] for k, s in series.items()}, holidays)
    return in_fold(made, [fold(DAYS, 5)], "train")


@pytest.fixture(scope="module")
def fitted(train, holidays):
    return {r.ad_unit: r for r in ma.fit_moving_average(train, holidays).collect()}


def test_planted_terms_are_recovered(fitted):
    assert (fitted["up"].non_seasonal_d, fitted["up"].non_seasonal_q) == (0, 1)
    assert fitted["up"].ma_coefficients[0] == pytest.approx(0.7, abs=0.15)
    assert (fitted["down"].non_seasonal_d, fitted["down"].non_seasonal_q) == (0, 1)
    assert fitted["down"].ma_coefficients[0] == pytest.approx(-0.5, abs=0.2)
    assert fitted["fading"].non_seasonal_p == 1
    assert fitted["fading"].ar_coefficients[0] == pytest.approx(0.7, abs=0.15)


def test_defined_cases(fitted):
    assert set(fitted) == {"up", "down", "fading", "constant", "few", "one"}
    for name in ("constant", "few", "one"):
        row = fitted[name]
        assert (row.non_seasonal_p, row.non_seasonal_q, row.ar_coefficients, row.ma_coefficients) == (0, 0, [], [])
        assert row.variance >= 0 and row.intercept_or_drift is not None
    assert fitted["few"].aic is None and fitted["one"].log_likelihood is None
    assert fitted["up"].arima_order == f"ARIMA({fitted['up'].non_seasonal_p},0,1)"


def test_recursion_solves_the_equations_of_the_autocovariances(spark):
    rng = np.random.default_rng(5)
    rows = []
    for _ in range(20):
        x = np.convolve(rng.normal(size=300), rng.normal(size=4))
        rows.append([float(x[k:] @ x[: len(x) - k] / len(x)) for k in range(ma.LONG + 1)])
    rows.append([0.0] * (ma.LONG + 1))
    got = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, r array<double>").select("i", ma.levinson(F.col("r")).alias("phi"))
    for row in got.collect():
        r = np.array(rows[row.i])
        square = np.array([[r[abs(a - b)] for b in range(ma.LONG)] for a in range(ma.LONG)])
        want = np.linalg.solve(square, r[1:]) if r[0] else np.zeros(ma.LONG)
        assert row.phi == pytest.approx(want.tolist(), abs=1e-8)


def test_both_stages_against_least_squares(train, holidays, fitted):
    rows = decompose_history(train, holidays).where("ad_unit = 'up'").orderBy("date").collect()
    x = np.array([r.e for r in rows])
    x = x - x.mean()
    n, k = len(x), ma.LONG
    r = np.array([x[j:] @ x[: n - j] / n for j in range(k + 1)])
    phi = np.linalg.solve(np.array([[r[abs(a - b)] for b in range(k)] for a in range(k)]), r[1:])
    a = np.full(n, np.nan)
    for t in range(k, n):
        a[t] = x[t] - phi @ x[t - k : t][::-1]
    y, terms, tried = x[k + 1 :], {"p": x[k:-1], "q": a[k:-1]}, []
    for rank, names in enumerate(["", "p", "q", "pq"]):
        design = np.column_stack([np.ones(len(y)), *[terms[c] for c in names]])
        beta, *_ = np.linalg.lstsq(design, y, rcond=None)
        variance = float(np.mean((y - design @ beta) ** 2))
        tried.append((round(len(y) * np.log(variance) + 2 * (1 + len(names)), 6), rank, names, beta[1:], variance))
    aic, _, names, beta, variance = min(tried, key=lambda t: t[:2])
    row = fitted["up"]
    assert (row.non_seasonal_p, row.non_seasonal_q) == ("p" in names, "q" in names)
    assert [*row.ar_coefficients, *row.ma_coefficients] == pytest.approx(beta.tolist(), abs=1e-6)
    assert row.variance == pytest.approx(variance) and row.aic == pytest.approx(aic, abs=1e-4)


def test_one_shuffle(spark, train, holidays, tmp_path):
    train.write.parquet(str(tmp_path / "train"))
    made = ma.fit_moving_average(spark.read.parquet(str(tmp_path / "train")), holidays)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert sum("Exchange hashpartitioning(fold_name" in line for line in plan.split("\n")) == 1, plan
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert ma.fit_moving_average(train.limit(0), holidays).count() == 0
