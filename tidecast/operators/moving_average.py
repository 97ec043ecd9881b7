"""Moving-average terms of the remainder, by two-stage regression (Hannan and Rissanen).

The remainder of the structural model is differenced as that model chose. A long autoregression, solved from the
autocovariances by the Levinson-Durbin recursion, gives estimates of the surprises; the remainder is then regressed on
its last value and on the last surprise, and the order with p and q in {0, 1} of least AIC stands.

Both stages need only sums per series. The days of a series (at most one row a day) travel through the aggregation that
gives the long autoregression and come out again with it, so a whole fit is one shuffle and no join.

Defined cases: a series with under ``MIN_SAMPLE`` days that have both terms has order (0, d, 0) and no AIC; a remainder
without variance has no terms; where both terms are mixes of each other only one is used; coefficients stay within
``MAX_PHI``; of equal AIC the order with fewer terms, then the autoregressive one stands.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidecast.operators.seasonal import KEYS
from tidecast.operators.structural import MAX_PHI, MIN_SAMPLE, NOISE_FLOOR, _best_order, decompose_history

LONG = 7  # order of the first stage: a week
TOLERANCE = 1e-9


def levinson(r: Column, order: int = LONG) -> Column:
    """Coefficients of the autoregression of ``order`` with the autocovariances ``r`` (from lag 0), as an array."""
    nothing = F.array().cast("array<double>")

    def step(done: Column, k: Column) -> Column:
        phi, v = done["phi"], done["v"]
        seen = F.reverse(F.slice(r, F.lit(2), k - 1))
        explained = F.aggregate(F.zip_with(phi, seen, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
        last = F.when(v > TOLERANCE * F.get(r, F.lit(0)), (F.get(r, k) - explained) / v).otherwise(F.lit(0.0))
        updated = F.zip_with(phi, F.reverse(phi), lambda a, b: a - last * b)
        return F.struct(F.concat(updated, F.array(last)).alias("phi"), (v * (1.0 - last * last)).alias("v"))

    start = F.struct(nothing.alias("phi"), F.get(r, F.lit(0)).alias("v"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(order)), start, step)["phi"]


def surprises(history: DataFrame, keys=KEYS, order: int = LONG) -> DataFrame:
    """Per day: d, the centred remainder x differenced d times, the day before's x1, and the surprise ``a`` of the long autoregression."""
    whole, in_time = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy("date")
    lags = [F.col("e"), *[F.lag("e", k).over(in_time) for k in range(1, order + 2)]]
    rows = history.select(
        *keys, "date", "e", "e1", "de", "de1", F.avg("e").over(whole).alias("m0"), F.avg("de").over(whole).alias("m1"),
        F.array(*lags).alias("back"),
    )
    at = [F.get("back", F.lit(k)) for k in range(order + 2)]
    rows = rows.withColumns(
        {
            "z0": F.array(*[at[k] - F.col("m0") for k in range(order + 1)]),
            "z1": F.array(*[at[k] - at[k + 1] - F.col("m1") for k in range(order + 1)]),
        }
    )

    def autocovariances(z: str) -> Column:
        now = F.get(z, F.lit(0))
        return F.array(*[F.coalesce(F.sum(now * F.get(z, F.lit(k))) / F.count(now), F.lit(0.0)) for k in range(order + 1)])

    series = rows.groupBy(*keys).agg(
        _best_order().getField("d").alias("d"),
        F.max("m0").alias("m0"),
        F.max("m1").alias("m1"),
        autocovariances("z0").alias("r0"),
        autocovariances("z1").alias("r1"),
        F.collect_list(F.struct("date", "z0", "z1")).alias("days"),
    )
    flat = F.col("d") == 0
    series = series.select(
        *keys, "d", F.when(flat, F.col("m0")).otherwise(F.col("m1")).alias("mean"),
        levinson(F.when(flat, F.col("r0")).otherwise(F.col("r1")), order).alias("long"), "days",
    )
    days = series.select(*keys, "d", "mean", "long", F.inline("days"))
    days = days.withColumn("z", F.when(flat, F.col("z0")).otherwise(F.col("z1")))
    a = F.get("z", F.lit(0))
    for k in range(1, order + 1):
        a = a - F.get("long", F.lit(k - 1)) * F.get("z", F.lit(k))
    return days.select(*keys, "date", "d", "mean", F.get("z", F.lit(0)).alias("x"), F.get("z", F.lit(1)).alias("x1"), a.alias("a"))


def _candidates() -> Column:
    """The order of least AIC as one struct; an expression of the moments of x, x1 and a1."""
    vx, v1, va, c1, ca, c1a = (F.col(c) for c in ("vx", "v1", "va", "c1", "ca", "c1a"))
    zero, det = F.lit(0.0), v1 * va - c1a * c1a

    def clipped(over: Column, under: Column, least: Column) -> Column:
        value = F.when(under > least, over / under).otherwise(zero)
        return F.least(F.greatest(value, F.lit(-MAX_PHI)), F.lit(MAX_PHI))

    def candidate(rank: int, p: int, q: int, phi: Column, theta: Column) -> Column:
        error = vx - 2.0 * phi * c1 - 2.0 * theta * ca + phi * phi * v1 + theta * theta * va + 2.0 * phi * theta * c1a
        variance = F.greatest(error, F.lit(NOISE_FLOOR))
        return F.struct(
            F.round(F.col("n") * F.log(variance) + 2.0 * (1 + p + q), 6).alias("aic"),
            F.lit(rank).alias("rank"),
            F.lit(p).cast("bigint").alias("p"),
            F.lit(q).cast("bigint").alias("q"),
            phi.alias("phi"),
            theta.alias("theta"),
            variance.alias("variance"),
        )

    least = TOLERANCE * v1 * va
    made = [
        candidate(0, 0, 0, zero, zero),
        candidate(1, 1, 0, clipped(c1, v1, zero), zero),
        candidate(2, 0, 1, zero, clipped(ca, va, zero)),
        candidate(3, 1, 1, clipped(c1 * va - ca * c1a, det, least), clipped(ca * v1 - c1 * c1a, det, least)),
    ]
    none = F.lit(None).cast("double")
    flat = F.struct(
        none.alias("aic"), F.lit(0).alias("rank"), F.lit(0).cast("bigint").alias("p"), F.lit(0).cast("bigint").alias("q"),
        zero.alias("phi"), zero.alias("theta"), F.coalesce("spread", zero).alias("variance"),
    )
    return F.when(F.col("n") < MIN_SAMPLE, flat).otherwise(F.array_min(F.array(*made)))


def fit_moving_average(train: DataFrame, holidays: DataFrame, keys=KEYS) -> DataFrame:
    """A row per series: order, coefficients, mean or drift, variance, likelihood and AIC of the remainder."""
    days = surprises(decompose_history(train, holidays, keys), keys)
    days = days.withColumn("a1", F.lag("a").over(Window.partitionBy(*keys).orderBy("date")))
    x, x1, a1 = (F.when(F.col("a1").isNotNull(), F.col(c)) for c in ("x", "x1", "a1"))
    moments = days.groupBy(*keys, "d", "mean").agg(
        F.count(a1).alias("n"),
        F.var_pop("x").alias("spread"),
        F.var_pop(x).alias("vx"),
        F.var_pop(x1).alias("v1"),
        F.var_pop(a1).alias("va"),
        F.covar_pop(x, x1).alias("c1"),
        F.covar_pop(x, a1).alias("ca"),
        F.covar_pop(x1, a1).alias("c1a"),
    )
    best = moments.select(*keys, "d", "mean", "n", _candidates().alias("best")).select(*keys, "d", "mean", "n", "best.*")
    empty = F.array().cast("array<double>")
    likelihood = -0.5 * F.col("n") * (F.log(2.0 * F.pi() * F.col("variance")) + 1.0)
    return best.select(
        *keys,
        F.col("p").alias("non_seasonal_p"),
        F.col("d").alias("non_seasonal_d"),
        F.col("q").alias("non_seasonal_q"),
        F.format_string("ARIMA(%d,%d,%d)", "p", "d", "q").alias("arima_order"),
        F.when(F.col("p") == 1, F.array("phi")).otherwise(empty).alias("ar_coefficients"),
        F.when(F.col("q") == 1, F.array("theta")).otherwise(empty).alias("ma_coefficients"),
        F.coalesce("mean", F.lit(0.0)).alias("intercept_or_drift"),
        "variance",
        F.when(F.col("aic").isNotNull(), likelihood).alias("log_likelihood"),
        "aic",
    )
