import numpy as np
from pyspark.sql import functions as F

from tests.frames import daily, fold
from tidecast.operators.folds import in_fold
from tidecast.operators.seasons import autocorrelations, detect_seasons
from tidecast.sources.holidays import holiday_dim

DAYS = 600


def test_planted_seasons(spark):
    rng = np.random.default_rng(4)
    noise = lambda: rng.normal(0, 100, DAYS)
    pattern = lambda n: np.resize(rng.permutation(n) * 600.0 / n, DAYS)
    fading = [0.0]
    for u in noise()[1:]:
        fading.append(0.9 * fading[-1] + u)
    series = {
        "week": 5000 + pattern(7) + noise(),
        "month": 5000 + pattern(30) + noise(),
        "rising": 5000 + 20 * np.arange(DAYS) + pattern(7) + noise(),
        "line": 5000 + 20.0 * np.arange(DAYS),
        "fading": 5000 + np.array(fading),
        "constant": np.full(DAYS, 7.0),
        "short": np.resize([1.0, 9.0, 5.0, 5.0, 5.0, 5.0, 5.0], 10),
        "one": np.array([5.0]),
        **{f"noise{k}": 5000 + noise() for k in range(8)},
    }
    made = daily(spark, {k: [int(round(x)) for x in s] for k, s in series.items()}, holiday_dim(spark, 2022, 2025))
    train = in_fold(made, [fold(DAYS, 5)], "train")
    found = {}
    for r in detect_seasons(train).collect():
        found.setdefault(r.ad_unit, []).append(r.period)
    assert found == {"week": [7], "month": [30], "rising": [7]}
    assert detect_seasons(train.limit(0)).count() == 0


def test_autocorrelations_against_numpy(spark):
    x = np.random.default_rng(6).normal(size=50)
    got = spark.createDataFrame([([float(v) for v in x],)], "x array<double>").select(autocorrelations(F.col("x"), 60).alias("r")).first().r
    want = [x[k:] @ x[: 50 - k] / (x @ x) if k < 50 else 0.0 for k in range(1, 61)]
    assert np.allclose(got, want)
