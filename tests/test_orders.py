from datetime import timedelta

import numpy as np
import pytest

from tests.frames import DAY0, daily, fold
from tidecast.operators import orders
from tidecast.operators.folds import in_fold
from tidecast.sources.holidays import holiday_dim

DAYS = 800
KEYS = ["ad_unit"]


def autoregression(phi, u):
    out = [0.0] * len(phi)
    for x in u:
        out.append(sum(f * out[-k] for k, f in enumerate(phi, 1)) + x)
    return np.array(out[len(phi) :])


def planted():
    rng = np.random.default_rng(11)
    noise = lambda n=DAYS: rng.normal(0, 100, n)
    third = [0.5, -0.3, 0.3]
    return {
        "quiet": noise(),
        "third": autoregression(third, noise()) + 40.0,
        "walk": np.cumsum(noise()),
        "drifting": np.cumsum(noise() + 30.0),
        "walk of third": np.cumsum(autoregression(third, noise())),
        "twice": np.cumsum(np.cumsum(noise())),
        "constant": np.zeros(60),
        "line": np.arange(60.0),
        "few": np.array([1.0, 5.0, 2.0, 9.0]),
        "one": np.array([5.0]),
    }


def frame(spark, series):
    rows = [(unit, DAY0 + timedelta(days=i), None if np.isnan(v) else float(v)) for unit, e in series.items() for i, v in enumerate(e)]
    return spark.createDataFrame(rows, "ad_unit string, date date, e double").orderBy("e")


@pytest.fixture(scope="module")
def fitted(spark):
    found = orders.choose_orders(frame(spark, planted()), KEYS)
    return {r.ad_unit: r for r in found.collect()}


def statistic(x):
    n, z = len(x), x - x.mean()
    reach = int(4 * (n / 100) ** 0.25)
    cov = [z[k:] @ z[: n - k] / n for k in range(reach + 1)]
    long_run = cov[0] + 2 * sum((1 - k / (reach + 1)) * cov[k] for k in range(1, reach + 1))
    return float(np.sum(np.cumsum(z) ** 2) / n**2 / long_run)


def by_hand(x):
    d = 0
    while d < 2 and np.var(x) > 1e-9 and statistic(x) > 0.463:
        x, d = np.diff(x), d + 1
    n, z, tried = len(x), x - x.mean(), []
    cov = np.array([z[k:] @ z[: n - k] / n for k in range(6)])
    for p in range(6):
        square = np.array([[cov[abs(a - b)] for b in range(p)] for a in range(p)]).reshape(p, p)
        phi = np.linalg.solve(square, cov[1 : p + 1]) if p and cov[0] > 1e-9 else np.zeros(p)
        variance = max(cov[0] - phi @ cov[1 : p + 1], 1e-9)
        tried.append((round(n * np.log(variance) + 2 * (1 + p), 6), p, phi, variance))
    return d, *min(tried, key=lambda t: t[:2])


def test_planted_orders_are_found(fitted):
    order = {u: (r.non_seasonal_p, r.non_seasonal_d) for u, r in fitted.items()}
    assert order["quiet"][1] == 0 and order["third"][1] == 0 and order["third"][0] >= 3
    assert order["walk"][1] == 1 and order["drifting"][1] == 1 and order["twice"][1] == 2
    assert order["walk of third"][1] == 1 and order["walk of third"][0] >= 3
    assert fitted["third"].ar_coefficients[:3] == pytest.approx([0.5, -0.3, 0.3], abs=0.12)
    assert fitted["third"].intercept_or_drift == pytest.approx(40.0, abs=20)
    assert fitted["drifting"].intercept_or_drift == pytest.approx(30.0, abs=11)
    assert fitted["twice"].intercept_or_drift == 0


def test_every_choice_equals_the_equations_solved_by_hand(fitted):
    for unit, x in planted().items():
        if len(x) < 14:
            continue
        d, aic, p, phi, variance = by_hand(x)
        row = fitted[unit]
        assert (row.non_seasonal_d, row.non_seasonal_p) == (d, p), unit
        assert row.ar_coefficients == pytest.approx(list(phi), abs=1e-6)
        assert row.variance == pytest.approx(variance, rel=1e-6) and row.aic == pytest.approx(aic, abs=1e-3)
        if np.var(x) > 1e-9:
            assert row.kpss_0 == pytest.approx(statistic(x), rel=1e-6)


def test_defined_cases(spark, fitted):
    assert set(fitted) == set(planted())
    for unit in ("few", "one", "constant"):
        row = fitted[unit]
        assert (row.arima_order, row.ar_coefficients, row.kpss_0) == ("ARIMA(0,0,0)", [], None)
    assert fitted["few"].aic is None and fitted["one"].variance is None and fitted["constant"].aic is not None
    assert (fitted["line"].non_seasonal_d, fitted["line"].non_seasonal_p) == (1, 0)
    holes = planted()["third"].copy()
    holes[[3, 50]] = np.nan
    row = orders.choose_orders(frame(spark, {"third": holes, "nothing": np.array([np.nan])}), KEYS).collect()
    assert [(r.ad_unit, r.n_days) for r in row] == [("third", DAYS - 2)]
    assert orders.choose_orders(frame(spark, planted()).limit(0), KEYS).count() == 0


def test_forecast_continues_the_remainder(spark, fitted):
    found = orders.choose_orders(frame(spark, planted()), KEYS)
    got = {}
    for r in orders.remainder_forecast(found, 12, KEYS).orderBy("ad_unit", "h").collect():
        got.setdefault(r.ad_unit, []).append((r.remainder, r.variance))
    assert set(got) == set(fitted) and all(len(v) == 12 for v in got.values())
    for unit, x in planted().items():
        row, d = fitted[unit], fitted[unit].non_seasonal_d
        w = list(np.diff(x, d))
        phi, m = row.ar_coefficients, row.intercept_or_drift
        for _ in range(12):
            w.append(m + sum(f * (w[-k] - m) for k, f in enumerate(phi, 1)))
        ahead = np.array(w[-12:])
        influence = [1.0]
        for _ in range(11):
            influence.append(sum(f * influence[-k] for k, f in enumerate(phi, 1) if k <= len(influence)))
        for level in reversed(range(d)):
            ahead = np.diff(x, level)[-1] + np.cumsum(ahead)
            influence = np.cumsum(influence)
        assert [v[0] for v in got[unit]] == pytest.approx(ahead.tolist(), rel=1e-6, abs=1e-4), unit
        if row.variance is None:
            assert {v[1] for v in got[unit]} == {None}
        else:
            want = (row.variance * np.cumsum(np.square(influence))).tolist()
            assert [v[1] for v in got[unit]] == pytest.approx(want, rel=1e-6), unit


def test_one_shuffle(spark, tmp_path):
    holidays = holiday_dim(spark, 2022, 2025)
    made = daily(spark, {"a": [int(5000 + x) for x in planted()["third"]], "b": [7] * 30}, holidays)
    in_fold(made, [fold(700, 5)], "train").write.parquet(str(tmp_path / "train"))
    train = spark.read.parquet(str(tmp_path / "train"))
    chosen = orders.fit_orders(train, holidays)
    plan = chosen._jdf.queryExecution().executedPlan().toString()
    assert sum("Exchange hashpartitioning(fold_name" in line for line in plan.split("\n")) == 1, plan
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert {r.ad_unit: r.n_days for r in chosen.collect()} == {"a": 700, "b": 30}
    assert orders.fit_orders(train.limit(0), holidays).count() == 0
