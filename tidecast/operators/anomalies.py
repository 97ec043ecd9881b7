"""Reading the anomalies table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidecast.config import ANOMALY_PROBABILITY
from tidecast.functions import scalars as fn

POINT = [
    "date",
    "ad_unit",
    "daily_impressions",
    "is_anomaly",
    "lower_bound",
    "upper_bound",
    "anomaly_probability",
]


def flagged(
    anomalies: DataFrame, units: list[str] | None, fold: str, threshold: float = ANOMALY_PROBABILITY
) -> DataFrame:
    """Points with the flag set or a probability of at least ``threshold``."""
    rows = anomalies.where(
        (F.col("fold_name") == fold) & ((F.col("anomaly_probability") >= threshold) | F.col("is_anomaly"))
    )
    return (rows if units is None else rows.where(F.col("ad_unit").isin(units))).select(*POINT)


def anomaly_series(anomalies: DataFrame, unit: str, fold: str) -> DataFrame:
    """Every point of one series, flagged or not, in order."""
    rows = anomalies.where((F.col("ad_unit") == unit) & (F.col("fold_name") == fold))
    return rows.select(*POINT).orderBy("date")


def anomaly_type() -> Column:
    y = F.col("daily_impressions")
    return (
        F.when(y > F.col("upper_bound"), F.lit("HIGH_SPIKE"))
        .when(y < F.col("lower_bound"), F.lit("LOW_DIP"))
        .otherwise(F.lit("UNKNOWN"))
    )


def _described(anomalies: DataFrame) -> DataFrame:
    centre = (F.col("lower_bound") + F.col("upper_bound")) / 2.0
    half = (F.col("upper_bound") - F.col("lower_bound")) / 2.0
    return anomalies.select(
        "date",
        "ad_unit",
        "fold_name",
        F.round("daily_impressions", 0).alias("impressions"),
        F.round("lower_bound", 0).alias("expected_lower"),
        F.round("upper_bound", 0).alias("expected_upper"),
        F.round("anomaly_probability", 4).alias("probability"),
        anomaly_type().alias("anomaly_type"),
        F.round(fn.ratio(F.col("daily_impressions") - centre, half), 2).alias("deviation_ratio"),
        "anomaly_probability",
    )


def explore_top(anomalies: DataFrame, n: int = 100) -> DataFrame:
    """The ``n`` surest anomalies with their direction and deviation in half-widths."""
    top = _described(anomalies.where("is_anomaly"))
    order = [F.desc("anomaly_probability"), "date", "ad_unit", "fold_name"]
    return top.orderBy(*order).limit(n).drop("anomaly_probability")


def anomalies_by_date(anomalies: DataFrame, at_least: int = 3, n: int = 50) -> DataFrame:
    """The ``n`` dates on which most series were flagged: one row per flagged series and date.

    Reads ``anomalies`` twice: pass a stored table.
    """
    hits = anomalies.where("is_anomaly")
    dates = (
        hits.groupBy("date")
        .agg(
            F.count(F.lit(1)).alias("articles_affected"),
            F.round(F.avg("anomaly_probability"), 4).alias("avg_probability"),
        )
        .where(F.col("articles_affected") >= at_least)
        .orderBy(F.desc("articles_affected"), "date")
        .limit(n)
    )
    return hits.join(dates, "date").select(
        "date",
        "articles_affected",
        "avg_probability",
        F.col("ad_unit").alias("affected_article"),
        "fold_name",
        F.col("anomaly_probability").alias("probability"),
    )


def anomaly_rate(anomalies: DataFrame) -> DataFrame:
    """Share of flagged days per series, and the mean probability of the flagged ones."""
    hit = F.col("is_anomaly")
    counted = anomalies.groupBy("ad_unit").agg(
        F.count(F.lit(1)).alias("total_days"),
        F.count_if(hit).alias("anomaly_days"),
        F.round(F.avg(F.when(hit, F.col("anomaly_probability"))), 4).alias("avg_anomaly_probability"),
    )
    rate = fn.ratio(F.col("anomaly_days"), F.col("total_days")) * 100
    return counted.withColumn("anomaly_rate_pct", F.round(rate, 1))


def probe_dates(anomalies: DataFrame, units: list[str], when: Column) -> DataFrame:
    """What the model said about chosen series on chosen dates, such as Sundays in February."""
    return anomalies.where(F.col("ad_unit").isin(units) & when).select(
        "date",
        "ad_unit",
        "fold_name",
        F.round("daily_impressions", 0).alias("impressions"),
        F.round("anomaly_probability", 4).alias("probability"),
        "is_anomaly",
    )


def sundays_in(month: int) -> Column:
    return (F.month("date") == month) & (F.dayofweek("date") == 1)
