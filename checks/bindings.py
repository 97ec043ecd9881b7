"""The given test tables read as hourly counts, and the frames the checks share."""

from __future__ import annotations

from datetime import date
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidecast.config import Fold
from tidecast.operators.calendar import build_daily
from tidecast.operators.explore import distribution_stats
from tidecast.operators.events import event_table, guidance_table
from tidecast.operators.folds import in_fold
from tidecast.operators.metrics import (
    business_impact,
    compare_models,
    cross_fold,
    forecast_metrics,
    melt_metrics,
)
from tidecast.operators.regression import fit_xreg, forecast_xreg
from tidecast.operators.rollup import daily_rollup
from tidecast.operators.seasonal import forecast_zero_shot
from tidecast.operators.structural import (
    detect_anomalies,
    evaluate_orders,
    explain_forecast,
    fit_structural,
)
from tidecast.plans.daily_load import complete_daily
from tidecast.plans.walk_forward import fold_features
from tidecast.sources.holidays import holiday_dim
from tidecast.sources.workspace import settle

START, END = date(1995, 1, 2), date(2001, 11, 4)
GAPPY_START, GAPPY_END = date(1995, 1, 1), date(2001, 8, 1)
FIRST_YEAR, LAST_YEAR = 1995, 2001
FOLDS = [
    Fold.of("fold_1", "1995-01-02", "2000-06-30", "2000-07-01", "2000-09-30"),
    Fold.of("fold_2", "1995-01-02", "2000-09-30", "2000-10-01", "2000-12-31"),
]
UNITS = ["A", "N", "R"]
EVENTS = {
    "A": [("1999-12-25", "Winter release", "Seasonal"), ("2000-02-29", "Leap day launch", "Product Launch")],
    "N": [("1998-07-12", "Final", "Sports Event"), ("2000-01-01", "Millennium", "Viral-Unpredictable")],
    "R": [("1997-05-02", "Opening", "Entertainment Release")],
}


class Bound:
    """Frames over one directory of test tables. Those named ``*_kept`` run a job when first read; nothing is kept between queries."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    # -- hourly counts --

    def _hourly_from_lines(self, lines: DataFrame, title: str) -> DataFrame:
        return lines.select(
            F.col("l_shipdate").alias("datehour"),
            F.when(F.col("l_linestatus") == "O", "en").otherwise("en.m").alias("wiki"),
            F.col(title).alias("title"),
            F.col("l_quantity").cast("bigint").alias("views"),
        )

    @cached_property
    def hourly(self) -> DataFrame:
        return self._hourly_from_lines(self.table("lineitem"), "l_returnflag")

    @cached_property
    def hourly_wide(self) -> DataFrame:
        brands = self.table("part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
        return self._hourly_from_lines(self.table("lineitem").join(brands, "l_partkey"), "p_brand")

    @cached_property
    def hourly_gappy(self) -> DataFrame:
        return self.table("orders").select(
            F.col("o_orderdate").alias("datehour"),
            F.when(F.col("o_orderstatus") == "O", "en").otherwise("en.m").alias("wiki"),
            F.col("o_orderpriority").alias("title"),
            F.floor("o_totalprice").cast("bigint").alias("views"),
        )

    @cached_property
    def hourly_clock(self) -> DataFrame:
        return self.table("events").select(
            F.col("ts").alias("datehour"),
            F.when(F.col("user_id") % 2 == 0, "en").otherwise("en.m").alias("wiki"),
            F.col("event_type").alias("title"),
            F.lit(1).cast("bigint").alias("views"),
        )

    # -- daily series --

    @cached_property
    def holidays(self) -> DataFrame:
        return holiday_dim(self.spark, FIRST_YEAR, LAST_YEAR)

    @cached_property
    def raw(self) -> DataFrame:
        return daily_rollup(self.hourly)

    @cached_property
    def raw_gappy(self) -> DataFrame:
        return daily_rollup(self.hourly_gappy)

    @cached_property
    def raw_wide(self) -> DataFrame:
        return daily_rollup(self.hourly_wide)

    @cached_property
    def daily(self) -> DataFrame:
        return complete_daily(self.raw, self.holidays, START, END)

    @cached_property
    def daily_gappy(self) -> DataFrame:
        return build_daily(self.raw_gappy, self.holidays)

    @cached_property
    def daily_wide(self) -> DataFrame:
        return complete_daily(self.raw_wide, self.holidays, START, END)

    # -- models; the daily table is written once where several branches read it --

    @cached_property
    def train(self) -> DataFrame:
        return in_fold(self.daily, FOLDS, "train")

    @cached_property
    def daily_kept(self) -> DataFrame:
        return settle(self.daily)

    @cached_property
    def daily_wide_kept(self) -> DataFrame:
        return settle(self.daily_wide)

    @cached_property
    def params(self) -> DataFrame:
        return fit_structural(self.train, self.holidays)

    @cached_property
    def evaluated(self) -> DataFrame:
        return evaluate_orders(self.params)

    @cached_property
    def decomposition(self) -> DataFrame:
        return explain_forecast(self.params, self.holidays)

    @cached_property
    def anomalies(self) -> DataFrame:
        return detect_anomalies(self.train, self.holidays)

    @cached_property
    def anomalies_wide(self) -> DataFrame:
        return detect_anomalies(in_fold(self.daily_wide, FOLDS, "train"), self.holidays)

    @cached_property
    def anomalies_wide_kept(self) -> DataFrame:
        return settle(self.anomalies_wide)

    @cached_property
    def stats_wide_kept(self) -> DataFrame:
        """One row per series."""
        return settle(distribution_stats(self.raw_wide))

    @cached_property
    def forecasts(self) -> DataFrame:
        """Zero-shot and regressor forecasts: two models, both folds."""
        daily = self.daily_kept
        train = in_fold(daily, FOLDS, "train")
        features = fold_features(daily, self.holidays, FOLDS)
        return forecast_zero_shot(train).unionByName(forecast_xreg(fit_xreg(train), features))

    @cached_property
    def forecasts_wide(self) -> DataFrame:
        daily = self.daily_wide_kept
        train = in_fold(daily, FOLDS, "train")
        features = fold_features(daily, self.holidays, FOLDS)
        return forecast_zero_shot(train).unionByName(forecast_xreg(fit_xreg(train), features))

    @cached_property
    def scores(self) -> DataFrame:
        return forecast_metrics(self.forecasts, self.daily_kept, FOLDS)

    @cached_property
    def metrics(self) -> DataFrame:
        return melt_metrics(self.scores, FOLDS)

    @cached_property
    def metrics_wide(self) -> DataFrame:
        """Long metrics of all 25 series, written once for the reports that read them repeatedly."""
        return settle(melt_metrics(forecast_metrics(self.forecasts_wide, self.daily_wide_kept, FOLDS), FOLDS))

    @cached_property
    def comparison(self) -> DataFrame:
        per_fold = compare_models(self.metrics_wide)
        return per_fold.unionByName(cross_fold(per_fold))

    @cached_property
    def impact(self) -> DataFrame:
        return business_impact(self.metrics_wide, self.daily_wide_kept, FOLDS)

    @cached_property
    def events(self) -> DataFrame:
        return event_table(self.spark, EVENTS)

    @cached_property
    def guidance(self) -> DataFrame:
        return guidance_table(self.spark)
