"""Per-series least squares on the calendar regressors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidecast.config import CONFIDENCE_LEVEL, REGRESSOR
from tidecast.functions import scalars as fn
from tidecast.operators.calendar import REGRESSORS, xreg_features
from tidecast.operators.seasonal import KEYS, forecast_rows

# A regressor that keeps less than this share of its variance is a mix of the ones before it.
TOLERANCE = 1e-9


def fit_xreg(train: DataFrame, keys=KEYS, regressors=REGRESSORS) -> DataFrame:
    """Intercept, coefficients and noise per series.

    The moments are one aggregation (combined on the map side); the small system is then solved
    by elimination in column expressions on the single row of each series.
    """
    k = len(regressors)
    x = [F.col(r).cast("double") for r in regressors]
    y = F.col("daily_impressions").cast("double")
    moments = (
        xreg_features(train)
        .groupBy(*keys)
        .agg(
            F.max("date").alias("last_date"),
            F.count(y).alias("n"),
            F.avg(y).alias("mean_y"),
            F.var_pop(y).alias("var_y"),
            *[F.avg(x[i]).alias(f"mean_{i}") for i in range(k)],
            *[F.covar_pop(x[i], x[j]).alias(f"a_{i}_{j}") for i in range(k) for j in range(i, k)],
            *[F.covar_pop(x[i], y).alias(f"b_{i}") for i in range(k)],
        )
    )
    solved = moments.withColumns({f"variance_{i}": F.col(f"a_{i}_{i}") for i in range(k)})
    solved = solved.withColumns({f"moment_{i}": F.col(f"b_{i}") for i in range(k)})
    for p in range(k):
        usable = F.col(f"a_{p}_{p}") > F.greatest(TOLERANCE * F.col(f"variance_{p}"), F.lit(1e-12))
        solved = solved.withColumn(f"pivot_{p}", F.when(usable, F.col(f"a_{p}_{p}")))
        below = {f"f_{i}": F.coalesce(F.col(f"a_{p}_{i}") / F.col(f"pivot_{p}"), F.lit(0.0)) for i in range(p + 1, k)}
        solved = solved.withColumns(below) if below else solved
        update = {
            f"a_{i}_{j}": F.col(f"a_{i}_{j}") - F.col(f"f_{i}") * F.col(f"a_{p}_{j}")
            for i in range(p + 1, k)
            for j in range(i, k)
        }
        update |= {f"b_{i}": F.col(f"b_{i}") - F.col(f"f_{i}") * F.col(f"b_{p}") for i in range(p + 1, k)}
        solved = solved.withColumns(update) if update else solved
    for p in reversed(range(k)):
        known = F.col(f"b_{p}")
        for j in range(p + 1, k):
            known = known - F.col(f"a_{p}_{j}") * F.col(f"beta_{j}")
        solved = solved.withColumn(f"beta_{p}", F.coalesce(known / F.col(f"pivot_{p}"), F.lit(0.0)))
    intercept, explained, used = F.col("mean_y"), F.lit(0.0), F.lit(1)
    for i in range(k):
        intercept = intercept - F.col(f"beta_{i}") * F.col(f"mean_{i}")
        explained = explained + F.col(f"beta_{i}") * F.col(f"moment_{i}")
        used = used + F.col(f"pivot_{i}").isNotNull().cast("int")
    freedom = F.col("n") - used
    noise = F.when(freedom > 0, F.col("n") * F.greatest(F.col("var_y") - explained, F.lit(0.0)) / freedom)
    result = solved.select(
        *keys,
        "last_date",
        "n",
        intercept.alias("intercept"),
        F.array(*[F.col(f"beta_{i}") for i in range(k)]).alias("coefficients"),
        F.sqrt(noise).alias("sigma"),
    )
    # One row in, one row out and no shuffle. A filter on forecasts stops here; pushed through the
    # elimination above it would be rewritten with every step copied into the next.
    values = [F.first(c).alias(c) for c in result.columns if c not in keys]
    return result.groupBy(*keys).agg(*values)


def forecast_xreg(
    params: DataFrame, features: DataFrame, level: float = CONFIDENCE_LEVEL, keys=KEYS, regressors=REGRESSORS
) -> DataFrame:
    """Forecast on future features. ``features`` holds the series id, and the fold if it is a key."""
    on = [k for k in keys if k in features.columns]
    rows = xreg_features(features).select(*on, "date", *regressors).join(params, on)
    rows = rows.where(F.col("date") > F.col("last_date")).withColumn("forecast_date", F.col("date"))
    value = F.col("intercept")
    for i, name in enumerate(regressors):
        value = value + F.element_at("coefficients", i + 1) * F.col(name).cast("double")
    return forecast_rows(rows, REGRESSOR, level, value, fn.z_score(level) * F.col("sigma"), keys)


def forecast_with(train: DataFrame, forecaster, schema, keys=KEYS) -> DataFrame:
    """Forecasts of a user's own model: ``forecaster`` gets one series as a pandas frame.

    A series has at most one row per day, so a group always fits one task.
    """
    return train.groupBy(*keys).applyInPandas(forecaster, schema)
