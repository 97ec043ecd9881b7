"""Structural decomposition model: spikes, steps, trend, seasons, holidays and an AR remainder.

Everything is window and aggregate expressions partitioned by series, so one shuffle by series
serves the whole fit, and a series is bounded by its number of days. The result of a fit is a
table with one row per series and fold, not an opaque object.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidecast.config import (
    ANOMALY_PROBABILITY,
    CONFIDENCE_LEVEL,
    HORIZON,
    STEP_RATIO,
    STEP_WINDOW,
    STRUCTURAL,
)
from tidecast.functions import scalars as fn
from tidecast.operators.calendar import one_per_date, with_holidays
from tidecast.operators.seasonal import KEYS, forecast_rows

SPIKE_REACH = 14
SPIKE_WIDTH = 3.0
MIN_NEIGHBOURS = 7
YEAR_DAYS = 365
MIN_SAMPLE = 14
MAX_PHI = 0.98
NOISE_FLOOR = 1e-9


# ---- in-sample decomposition --------------------------------------------------------------------


def decompose_history(train: DataFrame, holidays: DataFrame, keys=KEYS) -> DataFrame:
    """Each training day split into level, trend, seasons, holiday, spike and remainder ``e``."""
    rows = train.select(*keys, "date", F.col("daily_impressions").cast("double").alias("y"))
    rows = with_holidays(rows, one_per_date(holidays)).drop("is_holiday", "days_to_next_holiday")
    series = Window.partitionBy(*keys)
    in_time = series.orderBy("date")

    first, last = F.min("date").over(series), F.max("date").over(series)
    rows = rows.select(
        "*", first.alias("t0"), F.datediff("date", first).alias("t"), F.datediff(last, first).alias("span")
    )
    rows = _clean_spikes(rows, keys)
    rows = _remove_steps(rows, keys, in_time)

    t, adjusted = F.col("t"), F.col("adjusted")
    slope = F.coalesce(
        fn.positive_ratio(F.covar_pop(adjusted, t).over(series), F.var_pop(t).over(series)), F.lit(0.0)
    )
    rows = rows.withColumn("slope", slope).withColumn(
        "intercept", F.avg(adjusted).over(series) - F.col("slope") * F.avg(t).over(series)
    )
    rows = rows.withColumn("trend", F.col("intercept") + F.col("slope") * t)

    rows = rows.withColumn("detrended", adjusted - F.col("trend")).withColumn("dow", F.dayofweek("date"))
    rows = rows.withColumn(
        "weekly",
        F.avg("detrended").over(Window.partitionBy(*keys, "dow")) - F.avg("detrended").over(series),
    )
    rows = rows.withColumn("month", F.month("date")).withColumn("unseasoned", F.col("detrended") - F.col("weekly"))
    long_enough = F.col("span") + 1 >= YEAR_DAYS
    rows = rows.withColumn(
        "yearly", F.when(long_enough, F.avg("unseasoned").over(Window.partitionBy(*keys, "month")))
    )
    rows = rows.withColumn("rest", F.col("unseasoned") - F.coalesce(F.col("yearly"), F.lit(0.0)))
    rows = rows.withColumn(
        "holiday",
        F.when(
            F.col("holiday_name").isNotNull(), F.avg("rest").over(Window.partitionBy(*keys, "holiday_name"))
        ),
    )
    rows = rows.withColumn("e", F.col("rest") - F.coalesce(F.col("holiday"), F.lit(0.0)))
    rows = rows.withColumn("e1", F.lag("e").over(in_time)).withColumn("de", F.col("e") - F.col("e1"))
    return rows.withColumn("de1", F.lag("de").over(in_time))


def _clean_spikes(rows: DataFrame, keys) -> DataFrame:
    """Clamp each day to three deviations around its 28 neighbours, itself left out.

    Both halves of the neighbourhood are short frames of their own and are merged by their means
    and squared deviations, so one huge day does not drown the variance of later ones.
    """
    y = F.col("y")
    halves = {"b": (-SPIKE_REACH, -1), "a": (1, SPIKE_REACH)}
    sides = {side: fn.over_rows(keys, "date", *span) for side, span in halves.items()}
    terms = {"k": F.count(y), "m": F.avg(y), "v": F.var_pop(y)}
    rows = rows.select("*", *[term.over(w).alias(f"{name}_{side}") for side, w in sides.items() for name, term in terms.items()])
    (kb, mb, vb), (ka, ma, va) = ([F.coalesce(F.col(f"{name}_{side}"), F.lit(0.0)) for name in terms] for side in halves)
    k = kb + ka
    mean = fn.ratio(kb * mb + ka * ma, k)
    variance = fn.ratio(kb * vb + ka * va + fn.ratio(kb * ka, k) * (mb - ma) * (mb - ma), k - 1)
    reach = SPIKE_WIDTH * F.sqrt(F.greatest(variance, F.lit(0.0)))
    clamped = F.least(F.greatest(y, mean - reach), mean + reach)
    drop = [f"{name}_{side}" for name in terms for side in halves]
    rows = rows.withColumn("cleaned", F.when(k >= MIN_NEIGHBOURS, clamped).otherwise(y)).drop(*drop)
    return rows.withColumn("spike", y - F.col("cleaned"))


def _remove_steps(rows: DataFrame, keys, in_time) -> DataFrame:
    """Level shifts: full 30-row means before and after differ twofold, strongest row nearby."""
    near = fn.over_rows(keys, "date", -STEP_WINDOW, STEP_WINDOW)
    so_far = in_time.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("run", F.sum("cleaned").over(so_far))
    position = F.row_number().over(in_time)
    run, w = F.col("run"), float(STEP_WINDOW)
    before = (F.lag(run, 1).over(in_time) - F.lag(run, STEP_WINDOW + 1, 0.0).over(in_time)) / w
    rows = rows.select(
        "*",
        F.when(position > STEP_WINDOW, before).alias("before"),
        ((F.lead(run, STEP_WINDOW).over(in_time) - run) / w).alias("after"),
    )
    before, after = F.col("before"), F.col("after")
    strength = F.round(F.greatest(after / before, before / after), 2)
    rows = rows.withColumn("strength", F.when((before > 0) & (after > 0), strength))
    # Of equal strengths the earlier day wins.
    score = F.struct(F.col("strength"), (-F.col("t")).alias("earliness"))
    rows = rows.withColumn("score", F.when(F.col("strength") >= STEP_RATIO, score))
    best = F.max("score").over(near)
    rows = rows.withColumn("step", F.when(F.col("score") == best, after - before).otherwise(F.lit(0.0)))
    rows = rows.withColumn("is_step", F.col("step") != 0)
    rows = rows.withColumn("level", F.sum("step").over(in_time.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.withColumn("adjusted", F.col("cleaned") - F.col("level")).drop(
        "run", "before", "after", "strength", "score", "step"
    )


# ---- remainder: ARIMA(p,d,0) with p, d in {0, 1}, by least squares ------------------------------


def _best_order() -> Column:
    """The candidate of least AIC as one struct: order, coefficient, mean or drift, variance.

    Every candidate is scored on the rows where all of them are defined. AIC leads the struct and
    the number of terms follows, so the least struct is the choice and ties go to fewer terms. It
    is an expression of aggregates, to be used inside one ``agg``: a filter on the result stops at
    that aggregation instead of being copied down into the derivation.
    """
    sample = F.col("de1").isNotNull()
    e, e1, de, de1 = (F.when(sample, F.col(c)) for c in ("e", "e1", "de", "de1"))
    n = F.count(de1)
    mean_e, mean_e1, mean_d, mean_d1 = (F.avg(c) for c in (e, e1, de, de1))
    var_e, var_e1, var_d, var_d1 = (F.var_pop(c) for c in (e, e1, de, de1))
    cov_e, cov_d = F.covar_pop(e, e1), F.covar_pop(de, de1)

    def clipped(cov, var):
        phi = F.coalesce(fn.positive_ratio(cov, var), F.lit(0.0))
        return F.least(F.greatest(phi, F.lit(-MAX_PHI)), F.lit(MAX_PHI))

    def with_ar(var, phi, cov, var1):
        return var - 2.0 * phi * cov + phi * phi * var1

    zero = F.lit(0.0)
    phi_e, phi_d = clipped(cov_e, var_e1), clipped(cov_d, var_d1)
    # A drift that noise explains is left out: the differences are then fitted around zero.
    drifts = F.coalesce(F.abs(mean_d) > 1.96 * F.sqrt(var_d / F.when(n > 0, n)), F.lit(False))
    shift = mean_d - phi_d * mean_d1

    def unless_drifting(x):
        return F.when(drifts, zero).otherwise(x)

    def candidate(rank, p, d, phi, mu, variance, aic=True):
        floored = F.greatest(variance, F.lit(NOISE_FLOOR)) if aic else variance
        score = F.round(n * F.log(floored) + 2.0 * (1 + p), 6) if aic else F.lit(None).cast("double")
        return F.struct(
            score.alias("aic"),
            F.lit(rank).alias("rank"),
            F.lit(p).cast("bigint").alias("p"),
            F.lit(d).cast("bigint").alias("d"),
            phi.alias("phi"),
            mu.alias("mu"),
            floored.alias("variance"),
            (drifts & F.lit(d == 1)).alias("has_drift"),
            n.alias("n"),
        )

    candidates = [
        candidate(0, 0, 0, zero, mean_e, var_e),
        candidate(1, 0, 1, zero, F.when(drifts, mean_d).otherwise(zero), var_d + unless_drifting(mean_d * mean_d)),
        candidate(2, 1, 0, phi_e, (mean_e - phi_e * mean_e1) / (1.0 - phi_e), with_ar(var_e, phi_e, cov_e, var_e1)),
        candidate(
            3,
            1,
            1,
            phi_d,
            F.when(drifts, shift / (1.0 - phi_d)).otherwise(zero),
            with_ar(var_d, phi_d, cov_d, var_d1) + unless_drifting(shift * shift),
        ),
    ]
    flat = candidate(
        0, 0, 0, zero, F.coalesce(F.avg("e"), zero), F.coalesce(F.var_pop("e"), zero), aic=False
    )
    return F.when(n < MIN_SAMPLE, flat).otherwise(F.array_min(F.array(*candidates)))


PARAMETERS = (
    "t0 last_date n_days slope intercept level weekly yearly holiday_effects p d phi mu has_drift "
    "last_e last_de variance aic log_likelihood has_yearly has_holiday_effect has_spikes_and_dips "
    "has_step_changes"
).split()


def fit_structural(train: DataFrame, holidays: DataFrame, keys=KEYS) -> DataFrame:
    """Parameter table of the model: one row per fold and series."""
    history = decompose_history(train, holidays, keys)

    def per(column: str, by: str, count: int) -> Column:
        return F.array(*[F.max(F.when(F.col(by) == i, F.col(column))) for i in range(1, count + 1)])

    # At most one entry per name of the holiday dimension.
    effects = F.collect_set(
        F.when(F.col("holiday_name").isNotNull(), F.struct("holiday_name", F.col("holiday").alias("effect")))
    )
    fitted = history.groupBy(*keys).agg(
        F.min("t0").alias("t0"),
        F.max("date").alias("last_date"),
        F.count(F.lit(1)).alias("n_days"),
        F.max("slope").alias("slope"),
        F.max("intercept").alias("intercept"),
        F.max_by("level", "date").alias("level"),
        per("weekly", "dow", 7).alias("weekly"),
        per("yearly", "month", 12).alias("yearly"),
        F.map_from_entries(effects).alias("holiday_effects"),
        F.max_by("e", "date").alias("last_e"),
        F.max_by("de", "date").alias("last_de"),
        F.max(F.col("yearly").isNotNull()).alias("has_yearly"),
        F.max(F.col("holiday_name").isNotNull()).alias("has_holiday_effect"),
        F.max(F.abs("spike") > 1e-6).alias("has_spikes_and_dips"),
        F.max("is_step").alias("has_step_changes"),
        _best_order().alias("best"),
    )
    likelihood = -0.5 * F.col("n") * (F.log(2.0 * F.pi() * F.col("variance")) + 1.0)
    return (
        fitted.select("*", "best.*")
        .withColumn("log_likelihood", F.when(F.col("aic").isNotNull(), likelihood))
        .select(*keys, *PARAMETERS)
    )


# ---- forecasting --------------------------------------------------------------------------------


def explain_forecast(
    params: DataFrame, holidays: DataFrame, horizon: int = HORIZON, level: float = CONFIDENCE_LEVEL, keys=KEYS
) -> DataFrame:
    """Forecast with its parts; the residual is what the parts do not explain (the AR term)."""
    steps = params.select("*", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("h")).withColumn(
        "date", F.date_add("last_date", F.col("h"))
    )
    steps = with_holidays(steps, one_per_date(holidays))
    h, phi, mu = F.col("h").cast("double"), F.col("phi"), F.col("mu")
    decay = F.pow(phi, h)
    momentum = F.coalesce(F.col("last_de"), mu) - mu
    level_path = mu + decay * (F.col("last_e") - mu)
    drift_path = F.col("last_e") + h * mu + momentum * phi * (1.0 - decay) / (1.0 - phi)
    remainder = F.when(F.col("d") == 0, level_path).otherwise(drift_path)
    stationary = (1.0 - decay * decay) / (1.0 - phi * phi)
    integrated = (
        h - 2.0 * phi * (1.0 - decay) / (1.0 - phi) + phi * phi * (1.0 - decay * decay) / (1.0 - phi * phi)
    ) / ((1.0 - phi) * (1.0 - phi))
    growth = F.when(F.col("d") == 0, stationary).otherwise(integrated)

    parts = {
        "trend": F.col("intercept") + F.col("slope") * F.datediff("date", "t0"),
        "seasonal_period_weekly": F.element_at("weekly", F.dayofweek("date")),
        "seasonal_period_yearly": F.element_at("yearly", F.month("date")),
        "holiday_effect": F.coalesce(F.try_element_at("holiday_effects", F.col("holiday_name")), F.lit(0.0)),
        "spikes_and_dips": F.lit(0.0),
        "step_changes": F.col("level"),
    }
    steps = steps.select(
        *keys,
        F.col("date").alias("forecast_date"),
        *[c.alias(name) for name, c in parts.items()],
        F.coalesce(remainder, F.lit(0.0)).alias("residual"),
        (fn.z_score(level) * F.sqrt(F.col("variance") * growth)).alias("half_width"),
    )
    value = F.col("residual")
    for name in parts:
        value = value + F.coalesce(F.col(name), F.lit(0.0))
    return steps.withColumn("forecast_value", value).select(
        "forecast_date",
        *[k for k in keys][::-1],
        "forecast_value",
        (F.col("forecast_value") - F.col("half_width")).alias("prediction_interval_lower_bound"),
        (F.col("forecast_value") + F.col("half_width")).alias("prediction_interval_upper_bound"),
        *parts,
        "residual",
    )


def forecast_structural(
    params: DataFrame, holidays: DataFrame, horizon: int = HORIZON, level: float = CONFIDENCE_LEVEL, keys=KEYS
) -> DataFrame:
    explained = explain_forecast(params, holidays, horizon, level, keys)
    half = (F.col("prediction_interval_upper_bound") - F.col("prediction_interval_lower_bound")) / 2.0
    return forecast_rows(explained, STRUCTURAL, level, F.col("forecast_value"), half, keys)


# ---- anomalies ----------------------------------------------------------------------------------


def detect_anomalies(
    train: DataFrame, holidays: DataFrame, probability: float = ANOMALY_PROBABILITY, keys=KEYS
) -> DataFrame:
    """Training days whose one-step surprise is larger than ``probability`` of a normal one.

    The days of a series travel through the aggregation that chooses its order and come out again
    with the choice, so there is no second shuffle, no join, and one choice per series. A series
    has at most one row per day, which bounds the list.
    """
    carried = F.struct("date", "y", "level", "trend", "weekly", "yearly", "holiday", "e1", "de1")
    series = (
        decompose_history(train, holidays, keys)
        .groupBy(*keys)
        .agg(F.collect_list(carried).alias("days"), _best_order().alias("best"))
    )
    rows = series.select(*keys, "best.*", F.inline("days"))
    phi, mu = F.col("phi"), F.col("mu")
    e1 = F.col("e1")
    stationary = mu + phi * (F.coalesce(e1, mu) - mu)
    integrated = F.coalesce(e1, F.lit(0.0)) + mu + phi * (F.coalesce(F.col("de1"), mu) - mu)
    expected = (
        F.col("level")
        + F.col("trend")
        + F.col("weekly")
        + F.coalesce(F.col("yearly"), F.lit(0.0))
        + F.coalesce(F.col("holiday"), F.lit(0.0))
        + F.when(F.col("d") == 0, stationary).otherwise(integrated)
    )
    rows = rows.withColumn("expected", expected).withColumn("sd", F.sqrt("variance"))
    z = fn.positive_ratio(F.col("y") - F.col("expected"), F.col("sd"))
    chance = F.coalesce(fn.two_sided_probability(z), F.lit(0.0))
    half = fn.z_score(probability) * F.col("sd")
    return rows.withColumn("anomaly_probability", chance).select(
        "date",
        *[k for k in keys][::-1],
        F.col("y").alias("daily_impressions"),
        (F.col("anomaly_probability") > probability).alias("is_anomaly"),
        (F.col("expected") - half).alias("lower_bound"),
        (F.col("expected") + half).alias("upper_bound"),
        "anomaly_probability",
    )


# ---- inspection ---------------------------------------------------------------------------------


def coefficients(params: DataFrame, keys=KEYS) -> DataFrame:
    """AR terms, MA terms (always none) and the mean or drift of the remainder."""
    empty = F.array().cast("array<double>")
    return params.select(
        *keys,
        F.when(F.col("p") == 1, F.array("phi")).otherwise(empty).alias("ar_coefficients"),
        empty.alias("ma_coefficients"),
        F.col("mu").alias("intercept_or_drift"),
    )


def evaluate_orders(params: DataFrame, keys=KEYS) -> DataFrame:
    """Order, fit quality and what was detected, per series."""
    q = F.lit(0).cast("bigint")
    seasons = F.array_compact(
        F.array(F.lit("WEEKLY"), F.when(F.col("has_yearly"), F.lit("YEARLY")))
    )
    return params.select(
        *keys,
        F.col("p").alias("non_seasonal_p"),
        F.col("d").alias("non_seasonal_d"),
        q.alias("non_seasonal_q"),
        F.format_string("ARIMA(%d,%d,%d)", F.col("p"), F.col("d"), q).alias("arima_order"),
        "has_drift",
        "log_likelihood",
        "aic",
        "variance",
        seasons.alias("seasonal_periods"),
        "has_holiday_effect",
        "has_spikes_and_dips",
        "has_step_changes",
    )
