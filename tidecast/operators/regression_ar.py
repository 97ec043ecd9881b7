"""Calendar regression whose errors follow a first-order autoregression, by Cochrane-Orcutt iteration.

Plain least squares takes a day's error as new; the error of an inventory series mostly lasts for days. Here
y(t) = x(t) b + e(t), e(t) = phi e(t - 1) + u(t). Given phi, the quasi-differences y(t) - phi y(t - 1) on
x(t) - phi x(t - 1) have the plain error u, and given b the residuals have phi as their slope; both are estimated in turn.

Everything a round needs is in the cross products of a day and the day before it. They are summed once per series,
combined on the map side after one window, so all rounds run on the one row of a series and the data is read once.

Defined cases: null traffic is left out before days are paired; a regressor that is constant, or a mix of those before
it, gets no weight; phi stays within ``MAX_PHI``; phi is 0 where all residuals of earlier days are 0; with no freedom
left sigma is null; a series of one day has its value as intercept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidecast.config import CONFIDENCE_LEVEL, REGRESSOR
from tidecast.functions import scalars as fn
from tidecast.operators.calendar import REGRESSORS, xreg_features
from tidecast.operators.regression import TOLERANCE
from tidecast.operators.seasonal import KEYS, forecast_rows

ROUNDS = 8
MAX_PHI = 0.98


def solve(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, int]:
    """Coefficients of the normal equations and the number of columns used; a column without variance of its own is left out."""
    a, b = a.copy(), b.copy()
    k, own = len(b), np.diag(a).copy()
    used = [p for p in range(k)]
    for p in range(k):
        if a[p, p] <= max(TOLERANCE * own[p], 1e-12):
            used.remove(p)
            continue
        f = a[p + 1 :, p] / a[p, p]
        a[p + 1 :] -= np.outer(f, a[p])
        b[p + 1 :] -= f * b[p]
    out = np.zeros(k)
    for p in reversed(used):
        out[p] = (b[p] - a[p, p + 1 :] @ out[p + 1 :]) / a[p, p]
    return out, len(used)


def iterate(now: np.ndarray, cross: np.ndarray, before: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, float, float, int]:
    """(coefficients, phi, squared errors, columns used) from sums over pairs of days of products of (1, x, y).

    ``now`` has the products of the later days, ``before`` of the earlier ones, ``cross`` of later with earlier.
    """
    phi = 0.0
    for left in range(rounds, -1, -1):
        m = now - phi * (cross + cross.T) + phi * phi * before
        beta, used = solve(m[:-1, :-1], m[:-1, -1])
        w = np.append(-beta, 1.0)
        if left:
            last = w @ before @ w
            phi = float(np.clip(w @ cross @ w / last, -MAX_PHI, MAX_PHI)) if last > 0 else 0.0
    return beta, phi, max(float(w @ m @ w), 0.0), used


def _solved(columns: list[str]):
    def work(batches):
        for batch in batches:
            at = {name: batch.column(name).to_pylist() for name in ("n_pairs", "now", "crossed", "before", "last", "mean")}
            out = []
            for pairs, now, cross, before, last, mean in zip(*at.values()):
                k, mean = len(mean), np.array(mean)
                if pairs:
                    square = lambda v: np.array(v, dtype=float).reshape(k, k)
                    beta, phi, error, used = iterate(square(now), square(cross), square(before))
                else:
                    beta, phi, error, used = np.zeros(k - 1), 0.0, 0.0, k
                remainder = float(np.append(-beta, 1.0) @ np.array(last))
                intercept = float(beta[0] + mean[-1] - beta[1:] @ mean[1:-1])
                sigma = float(np.sqrt(error / (pairs - used))) if pairs > used else None
                out.append((intercept, beta[1:].tolist(), sigma, phi, remainder))
            kinds = (pa.float64(), pa.list_(pa.float64()), pa.float64(), pa.float64(), pa.float64())
            made = [pa.array(list(c), t) for c, t in zip(zip(*out), kinds)] if out else [pa.nulls(0, t) for t in kinds]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in columns], *made], [*columns, "intercept", "coefficients", "sigma", "phi", "last_e"])

    return work


def fit_xreg_ar(train: DataFrame, keys=KEYS, regressors=REGRESSORS) -> DataFrame:
    """Per series: last_date, n, intercept, coefficients, sigma (of u), phi and the last day's residual."""
    names = ["z0", *[f"z{i + 1}" for i in range(len(regressors))], f"z{len(regressors) + 1}"]
    values = [F.lit(1.0), *[F.col(x).cast("double") for x in regressors], F.col("daily_impressions").cast("double")]
    rows = xreg_features(train).where("daily_impressions IS NOT NULL").select(*keys, "date", *[v.alias(z) for z, v in zip(names, values)])
    whole, in_time = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy("date")
    rows = rows.select("*", *[F.avg(z).over(whole).alias(f"mean_{z}") for z in names[1:]])
    rows = rows.select(*keys, "date", "z0", *[f"mean_{z}" for z in names[1:]], *[(F.col(z) - F.col(f"mean_{z}")).alias(z) for z in names[1:]])
    rows = rows.select("*", *[F.lag(z).over(in_time).alias(f"l{z}") for z in names])
    paired = F.col("lz0").isNotNull()
    k = range(len(names))

    def total(a: str, b: str, name: str):
        return F.sum(F.when(paired, F.col(a) * F.col(b))).alias(name)

    sums = [total(names[i], names[j], f"now_{i}_{j}") for i in k for j in k if i <= j]
    sums += [total(f"l{names[i]}", f"l{names[j]}", f"before_{i}_{j}") for i in k for j in k if i <= j]
    sums += [total(names[i], f"l{names[j]}", f"crossed_{i}_{j}") for i in k for j in k]
    moments = rows.groupBy(*keys).agg(
        F.max("date").alias("last_date"),
        F.count(F.lit(1)).alias("n"),
        F.count("lz0").alias("n_pairs"),
        F.array(F.lit(1.0), *[F.first(f"mean_{z}") for z in names[1:]]).alias("mean"),
        F.max_by(F.array(*names), "date").alias("last"),
        *sums,
    )
    table = {s: F.array(*[F.col(f"{s}_{min(i, j)}_{max(i, j)}") for i in k for j in k]) for s in ("now", "before")}
    table["crossed"] = F.array(*[F.col(f"crossed_{i}_{j}") for i in k for j in k])
    packed = moments.select(*keys, "last_date", "n", "n_pairs", "mean", "last", *[v.alias(s) for s, v in table.items()])
    kept = [*keys, "last_date", "n"]
    schema = T.StructType([packed.schema[c] for c in kept] + T.StructType.fromDDL("intercept double, coefficients array<double>, sigma double, phi double, last_e double").fields)
    return packed.mapInArrow(_solved(kept), schema)


def forecast_xreg_ar(params: DataFrame, features: DataFrame, level: float = CONFIDENCE_LEVEL, keys=KEYS, regressors=REGRESSORS) -> DataFrame:
    """Forecasts on future features: the regression, the last residual fading by phi a day, bounds that widen accordingly."""
    on = [k for k in keys if k in features.columns]
    rows = xreg_features(features).select(*on, "date", *regressors).join(params, on)
    rows = rows.where(F.col("date") > F.col("last_date")).withColumn("forecast_date", F.col("date"))
    h, phi = F.datediff("date", "last_date").cast("double"), F.col("phi")
    value = F.col("intercept") + F.pow(phi, h) * F.col("last_e")
    for i, name in enumerate(regressors):
        value = value + F.element_at("coefficients", i + 1) * F.col(name).cast("double")
    growth = (1.0 - F.pow(phi, 2.0 * h)) / (1.0 - phi * phi)
    return forecast_rows(rows, REGRESSOR, level, value, fn.z_score(level) * F.col("sigma") * F.sqrt(growth), keys)
