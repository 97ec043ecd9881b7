"""Order of the remainder: differencing by the KPSS statistic, autoregression up to order five by AIC.

The remainder of the structural model is differenced until it no longer looks as if its level wandered, at most ``MAX_D``
times. The autoregressions of order 0 to ``MAX_P`` of what is left are solved from its autocovariances by the
Levinson-Durbin recursion, and the one of least AIC stands. ``remainder_forecast`` continues the remainder with it.

A series has at most one row a day, so its remainder fits one row; the whole choice is array expressions over one shuffle.

Defined cases: null remainders are left out before days are paired, a series of nulls alone has no row; a series of under ``MIN_SAMPLE`` days has order (0, 0, 0),
no statistic and no AIC; a remainder, or a difference, without variance is not differenced further and has no terms; of equal
AIC the order with fewer terms stands; a mean of the differences that noise explains is no drift, and differences of
second order have none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidecast.config import HORIZON
from tidecast.operators.moving_average import levinson
from tidecast.operators.seasonal import KEYS
from tidecast.operators.seasons import autocorrelations
from tidecast.operators.structural import MIN_SAMPLE, NOISE_FLOOR, decompose_history

MAX_P = 5
MAX_D = 2
WANDERS = 0.463  # five per cent point of the statistic for a constant level


def _sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda s, u: s + u)


def _product(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda u, v: u * v))


def differences(x: Column) -> Column:
    left = F.greatest(F.size(x) - 1, F.lit(0))
    return F.zip_with(F.slice(x, F.lit(2), left), F.slice(x, F.lit(1), left), lambda later, earlier: later - earlier)


def kpss(z: Column, variance: Column) -> Column:
    """Statistic of the centred array ``z``: squared partial sums over the long-run variance with triangular weights."""
    n = F.size(z)
    reach = F.floor(4.0 * F.pow(n / 100.0, F.lit(0.25))).cast("int")
    far = F.transform(autocorrelations(z, reach), lambda r, i: r * (1.0 - (i + 1) / (reach + 1.0)))
    long_run = 1.0 + 2.0 * _sum(far)
    start = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("q"))
    sums = F.aggregate(
        z, start, lambda t, u: F.struct((t["s"] + u).alias("s"), (t["q"] + (t["s"] + u) * (t["s"] + u)).alias("q"))
    )
    return F.when(long_run > NOISE_FLOOR, sums["q"] / (variance * long_run) / n / n).otherwise(F.lit(0.0))


def choose_orders(remainder: DataFrame, keys=KEYS) -> DataFrame:
    """A row per series of ``remainder`` (keys, date, e): order, statistics, coefficients, drift, fit and the last values."""
    # A filter on e would be copied down into its derivation; a list leaves nulls out as well.
    known = F.when(F.col("e").isNotNull(), F.struct("date", "e"))
    days = remainder.groupBy(*keys).agg(F.array_sort(F.collect_list(known)).alias("days")).where(F.size("days") > 0)
    rows = days.select(*keys, F.col("days.e").alias("x0"))
    for d in range(1, MAX_D + 1):
        rows = rows.withColumn(f"x{d}", differences(F.col(f"x{d - 1}")))
    rows = rows.withColumn("enough", F.size("x0") >= MIN_SAMPLE)
    each = range(MAX_D + 1)
    rows = rows.withColumns({f"m{d}": F.when(F.size(f"x{d}") > 0, _sum(F.col(f"x{d}")) / F.size(f"x{d}")) for d in each})
    # The mean as an array of its own: inside the function it would be summed anew for each day.
    centred = {f"z{d}": F.zip_with(f"x{d}", F.array_repeat(f"m{d}", F.size(f"x{d}")), lambda u, m: u - m) for d in each}
    rows = rows.withColumns(centred)
    rows = rows.withColumns({f"g{d}": F.when(F.col("enough"), _product(F.col(f"z{d}"), F.col(f"z{d}")) / F.size(f"z{d}")) for d in each})
    varies = [F.col(f"g{d}") > NOISE_FLOOR for d in each]
    rows = rows.withColumns({f"kpss_{d}": F.when(varies[d], kpss(F.col(f"z{d}"), F.col(f"g{d}"))) for d in range(MAX_D)})
    chosen = F.lit(MAX_D)
    for d in reversed(range(MAX_D)):  # null where there is too little, or no variance: not differenced further
        chosen = F.when(F.coalesce(F.col(f"kpss_{d}") > WANDERS, F.lit(False)), chosen).otherwise(F.lit(d))
    rows = rows.withColumn("d", chosen)

    def of_choice(name: str) -> Column:
        return F.coalesce(*[F.when(F.col("d") == d, F.col(f"{name}{d}")) for d in each])

    rows = rows.select(
        *keys, "d", *[f"kpss_{d}" for d in range(MAX_D)], "enough", of_choice("z").alias("z"), of_choice("g").alias("g"), of_choice("m").alias("m"),
        F.size("x0").alias("n_days"), F.slice("x0", -F.least(F.size("x0"), F.lit(MAX_P + MAX_D)), F.lit(MAX_P + MAX_D)).alias("last_e"),
    )
    rows = rows.withColumn("n", F.size("z"))
    none = F.array_repeat(F.lit(0.0), MAX_P)
    r = F.when(F.coalesce(F.col("g") > NOISE_FLOOR, F.lit(False)), autocorrelations(F.col("z"), MAX_P)).otherwise(none)
    rows = rows.withColumn("r", F.concat(F.array(F.lit(1.0)), r)).drop("z")
    rows = rows.withColumns({f"phi{p}": levinson(F.col("r"), p) for p in range(1, MAX_P + 1)})

    def candidate(p: int) -> Column:
        phi = F.col(f"phi{p}") if p else F.array().cast("array<double>")
        explained = _product(phi, F.slice("r", 2, p)) if p else F.lit(0.0)
        variance = F.greatest(F.col("g") * (1.0 - explained), F.lit(NOISE_FLOOR))
        aic = F.round(F.col("n") * F.log(variance) + 2.0 * (1 + p), 6)
        return F.struct(aic.alias("aic"), F.lit(p).cast("bigint").alias("p"), phi.alias("phi"), variance.alias("variance"))

    candidates = F.array(*[candidate(p) for p in range(MAX_P + 1)])
    rows = rows.withColumn("best", F.when(F.col("enough"), F.array_min(candidates)))
    rows = rows.select("*", "best.*")
    drifts = F.abs("m") > 1.96 * F.sqrt(F.col("g") / F.col("n"))
    level = F.when(F.col("d") == 0, F.col("m")).when((F.col("d") == 1) & drifts, F.col("m")).otherwise(F.lit(0.0))
    p = F.coalesce("p", F.lit(0).cast("bigint"))
    return rows.select(
        *keys,
        p.alias("non_seasonal_p"),
        F.col("d").cast("bigint").alias("non_seasonal_d"),
        F.lit(0).cast("bigint").alias("non_seasonal_q"),
        F.format_string("ARIMA(%d,%d,0)", p, F.col("d")).alias("arima_order"),
        *[f"kpss_{d}" for d in range(MAX_D)],
        F.coalesce("phi", F.array().cast("array<double>")).alias("ar_coefficients"),
        level.alias("intercept_or_drift"),
        "variance",
        F.when(F.col("enough"), -0.5 * F.col("n") * (F.log(2.0 * F.pi() * F.col("variance")) + 1.0)).alias("log_likelihood"),
        "aic",
        F.col("n_days").cast("bigint").alias("n_days"),
        "last_e",
    )


def fit_orders(train: DataFrame, holidays: DataFrame, keys=KEYS) -> DataFrame:
    """``choose_orders`` of the remainder that the structural model leaves."""
    return choose_orders(decompose_history(train, holidays, keys), keys)


def remainder_forecast(orders: DataFrame, horizon: int = HORIZON, keys=KEYS) -> DataFrame:
    """Per series and step h: the expected remainder and its variance.

    Both follow one recursion with the product of the autoregressive and the difference polynomials as its weights: the
    remainder from its last values, the influence of a surprise from a one. Series without a fit have no variance.
    """
    one = F.array(F.lit(1.0))
    weights = F.concat(one, F.transform("ar_coefficients", lambda phi: -phi))
    zero = F.array(F.lit(0.0))
    rows = orders.withColumn("w0", weights)
    for d in range(1, MAX_D + 1):
        before = F.col(f"w{d - 1}")
        rows = rows.withColumn(f"w{d}", F.zip_with(F.concat(before, zero), F.concat(zero, before), lambda a, b: a - b))
    chosen = F.coalesce(*[F.when(F.col("non_seasonal_d") == d, F.col(f"w{d}")) for d in range(MAX_D + 1)])
    rows = rows.select(*keys, "variance", "last_e", "ar_coefficients", "intercept_or_drift", chosen.alias("w"))
    # Weights of the last values, the latest first; a constant keeps the mean or the drift.
    rows = rows.withColumn("w", F.transform(F.slice("w", F.lit(2), F.size("w")), lambda u: -u))
    rows = rows.withColumn("c", F.col("intercept_or_drift") * (1.0 - _sum(F.col("ar_coefficients"))))
    steps = F.sequence(F.lit(1), F.lit(horizon))

    def path(start: Column, constant: Column) -> Column:
        """``start``, latest first, continued by ``horizon`` values."""
        reach = F.size("w")
        return F.aggregate(steps, start, lambda seen, _: F.concat(F.array(constant + _product(F.col("w"), F.slice(seen, F.lit(1), reach))), seen))

    past = F.reverse(F.slice("last_e", F.lit(1), F.size("last_e")))
    quiet = F.array_repeat(F.lit(0.0), MAX_P + MAX_D)
    rows = rows.withColumns({"made": path(past, F.col("c")), "influence": path(F.concat(one, quiet), F.lit(0.0))})
    rows = rows.select(
        *keys, "variance", F.reverse(F.slice("made", 1, horizon)).alias("made"), F.reverse(F.slice("influence", 2, horizon)).alias("influence")
    )
    start = F.array().cast("array<double>")
    squares = F.aggregate("influence", start, lambda s, u: F.concat(s, F.array(F.coalesce(F.try_element_at(s, F.lit(-1)), F.lit(0.0)) + u * u)))
    rows = rows.withColumn("growth", squares)
    steps_of = F.arrays_zip("made", "growth")
    rows = rows.select(*keys, "variance", F.posexplode(steps_of).alias("at", "step"))
    return rows.select(
        *keys, (F.col("at") + 1).cast("bigint").alias("h"), F.col("step.made").alias("remainder"), (F.col("variance") * F.col("step.growth")).alias("variance")
    )
