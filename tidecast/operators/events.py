"""Known events, their forecastability, and matching anomalies against them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidecast.schemas import schema

EVENT_SCHEMA = schema("ad_unit S, date D, event S, category S, position I")
GUIDANCE_SCHEMA = schema("category S, level S, guidance S")
VERTICAL_SCHEMA = schema("vertical S, ad_unit S")

# What each category of event means for a forecast.
GUIDANCE = [
    ("Sports Event", "High", "Add custom holiday regressors for game days"),
    ("Entertainment Release", "Medium", "Release dates known, magnitude uncertain"),
    ("Product Launch", "Medium", "Announcement dates predictable, impact varies"),
    ("Viral-Unpredictable", "Low", "Wide confidence intervals appropriate"),
    ("Seasonal", "High", "Annual patterns captured by yearly seasonality"),
]


def guidance_table(spark: SparkSession, rows=None) -> DataFrame:
    return _literal(spark, GUIDANCE if rows is None else rows, GUIDANCE_SCHEMA)


def _literal(spark: SparkSession, rows: list[tuple], columns: T.StructType) -> DataFrame:
    """A hand-kept list as literals of the plan, so that the optimizer knows its size."""
    if not rows:
        return spark.createDataFrame([], columns)
    values = [F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(row, columns.fields)]) for row in rows]
    return spark.range(1, numPartitions=1).select(F.inline(F.array(*values)))


def event_table(spark: SparkSession, registry: dict[str, list[tuple]]) -> DataFrame:
    """``{unit: [(date, name, category), ...]}`` as rows with their position in the list, which is kept by hand."""
    rows = [(unit, str(day), name, kind) for unit, events in registry.items() for day, name, kind in events]
    return _literal(spark, [(*row, position) for position, row in enumerate(rows)], EVENT_SCHEMA)


def vertical_table(spark: SparkSession, verticals: dict[str, list[str]]) -> DataFrame:
    """``{vertical: [units]}`` as rows."""
    rows = [(vertical, unit) for vertical, units in verticals.items() for unit in units]
    return spark.createDataFrame(rows, VERTICAL_SCHEMA)


def label_events(anomalies: DataFrame, events: DataFrame, guidance: DataFrame) -> DataFrame:
    """Every anomaly with its known event, category and guidance; empty text when there is none.

    Guidance is attached to the short event list, so the points take part in one join, on
    (series, date); a list of ordinary size is broadcast by its known size.
    """
    advice = guidance.select("category", F.col("guidance").alias("forecastability"))
    advised = events.drop("position").join(advice, "category", "left")
    labelled = anomalies.join(advised, ["ad_unit", "date"], "left")
    text = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("event", "category", "forecastability")]
    return labelled.select("date", "ad_unit", "daily_impressions", "anomaly_probability", *text)


def annotate_anomalies(anomalies: DataFrame, events: DataFrame) -> DataFrame:
    """Chart labels: the event name, the last listed of several, or ``Anomaly`` where no event is known."""
    last = events.groupBy("ad_unit", "date").agg(F.max_by("event", "position").alias("event"))
    return anomalies.join(last, ["ad_unit", "date"], "left").select(
        "ad_unit", "date", "anomaly_probability", F.coalesce("event", F.lit("Anomaly")).alias("label")
    )


def anomaly_summary(anomalies: DataFrame, events: DataFrame) -> DataFrame:
    """How many anomalies, how many on a known event date, and their mean probability."""
    known = events.select("ad_unit", "date").distinct().withColumn("known", F.lit(True))
    return anomalies.join(known, ["ad_unit", "date"], "left").agg(
        F.count(F.lit(1)).alias("total_anomalies"),
        F.count_if(F.col("known")).alias("matched_events"),
        F.avg("anomaly_probability").alias("avg_probability"),
    )
