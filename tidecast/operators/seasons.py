"""Seasons of a series, detected as peaks of its autocorrelation.

Days are differenced first, so that trends, level shifts and slowly fading errors do not look like seasons. A lag is a
season if its autocorrelation is higher than that of both neighbours and clear of what noise gives (``WIDTH`` over the root
of the number of differences), no other peak is clearly higher, and it is no multiple of a shorter peak that is as high.
So of two seasons of clearly different strength the stronger one is found; smooth long seasons lose strength by differencing.

A series has at most one row a day, so it fits one row; the whole detection is one shuffle.

Defined cases: null values are left out before days are paired; a season needs two whole periods; a series whose
differences do not vary (but for ``NOISE``, a share of its size), or too short, has no seasons and null strengths.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidecast.operators.seasonal import KEYS

MAX_PERIOD = 60
WIDTH = 5.0
NOISE = 1e-12


def autocorrelations(x: Column, lags: int) -> Column:
    """Array of the autocorrelations of lags 1 to ``lags`` of the centred array ``x``; 0 where no pair of days is left."""

    def product(a: Column, b: Column) -> Column:
        return F.aggregate(F.zip_with(a, b, lambda u, v: u * v), F.lit(0.0), lambda s, u: s + u)

    def shifted(k: Column) -> Column:
        left = F.greatest(F.size(x) - k, F.lit(0))
        return product(F.slice(x, F.lit(1), left), F.slice(x, k + 1, left)) / product(x, x)

    return F.transform(F.sequence(F.lit(1), F.lit(lags)), shifted)


def season_table(train: DataFrame, keys=KEYS, max_period: int = MAX_PERIOD) -> DataFrame:
    """A row per series: n differences, ``r`` (autocorrelations of lags 1 to ``max_period`` + 1) and the periods found."""
    days = train.where("daily_impressions IS NOT NULL").select(*keys, "date", F.col("daily_impressions").cast("double").alias("y"))
    series = days.groupBy(*keys).agg(
        (F.count(F.lit(1)) - 1).alias("n"), F.max(F.abs("y")).alias("size"), F.array_sort(F.collect_list(F.struct("date", "y"))).alias("days")
    )
    y, n = F.col("days.y"), F.col("n").cast("int")
    moves = F.zip_with(F.slice(y, F.lit(2), n), F.slice(y, F.lit(1), n), lambda later, earlier: later - earlier)
    series = series.select(*keys, "n", "size", moves.alias("moves"))
    mean = F.aggregate("moves", F.lit(0.0), lambda total, u: total + u) / F.col("n")
    series = series.select(*keys, "n", "size", "moves", F.when(F.col("n") > 0, mean).alias("mean"))
    series = series.select(*keys, "n", "size", F.transform("moves", lambda u: u - F.col("mean")).alias("x"))
    varies = F.aggregate("x", F.lit(0.0), lambda total, u: total + u * u) > NOISE * F.col("size") * F.col("size")
    r = F.when(varies, autocorrelations(F.col("x"), max_period + 1))
    series = series.select(*keys, "n", F.when(F.col("n") > 0, F.lit(WIDTH) / F.sqrt("n")).alias("clear"), r.alias("r"))

    def at(k: Column) -> Column:
        return F.get("r", k - 1)

    def is_peak(k: Column) -> Column:
        return (at(k) > at(k - 1)) & (at(k) >= at(k + 1)) & (at(k) > F.col("clear")) & (2 * k <= F.col("n"))

    series = series.select("*", F.filter(F.sequence(F.lit(2), F.lit(max_period)), is_peak).alias("peaks"))

    def beaten(k: Column) -> Column:
        clear = F.col("clear")
        return F.exists("peaks", lambda p: (at(p) > at(k) + clear) | ((p < k) & (k % p == 0) & (at(k) <= at(p) + clear)))

    return series.select(*keys, "n", "r", F.filter("peaks", lambda k: ~beaten(k)).alias("periods"))


def detect_seasons(train: DataFrame, keys=KEYS, max_period: int = MAX_PERIOD) -> DataFrame:
    """A row per series and season: period in days and its autocorrelation."""
    # An inner explode would push a filter on the periods down into their derivation and compute it anew per lag.
    found = season_table(train, keys, max_period).select(*keys, "r", F.explode_outer("periods").alias("k"))
    return found.where("k IS NOT NULL").select(*keys, F.col("k").cast("bigint").alias("period"), F.get("r", F.col("k") - 1).alias("autocorrelation"))
