"""Small hand-made frames."""

from datetime import date, timedelta

from tidecast.config import Fold
from tidecast.operators.calendar import with_features
from tidecast.schemas import schema

DAY0 = date(2023, 1, 1)


def day(i: int) -> date:
    return DAY0 + timedelta(days=i)


def volumes(spark, series: dict[str, list]):
    """Series of daily values from 2023-01-01 on; None is a missing day. Desktop gets a third."""
    rows = [
        (day(i), unit, v, v // 3, v - v // 3)
        for unit, values in series.items()
        for i, v in enumerate(values)
        if v is not None
    ]
    return spark.createDataFrame(
        rows, schema("date D, ad_unit S, daily_impressions I, desktop_impressions I, mobile_impressions I")
    )


def daily(spark, series, holidays):
    return with_features(volumes(spark, series), holidays)


def fold(train_days: int, test_days: int, name: str = "fold_1") -> Fold:
    return Fold(name, DAY0, day(train_days - 1), day(train_days), day(train_days + test_days - 1))


def forecast_frame(spark, rows):
    """(day number, unit, value, lower, upper)"""
    return spark.createDataFrame(
        [(day(i), u, "m", "fold_1", v, lo, hi, 0.95) for i, u, v, lo, hi in rows],
        schema(
            "forecast_date D, ad_unit S, model_name S, fold_name S, forecast_value F, forecast_lower F?, "
            "forecast_upper F?, confidence_level F"
        ),
    )
