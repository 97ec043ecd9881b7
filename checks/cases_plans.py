"""Plans that store their tables, and round trips of the sinks; what they return is read back from the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from checks.bindings import END, FOLDS, START, UNITS, Bound
from checks.cases_models import _ANOMALIES, _DECOMPOSED, _PARTS, _RETRAINED
from checks.cases_tables import _SHOWN, _VALIDATED, _shards
from checks.registry import case, rounded
from tidecast.operators import quality
from tidecast.plans.daily_load import run_load
from tidecast.plans.retrain import retrain_and_publish
from tidecast.plans.walk_forward import run_walk_forward
from tidecast.schemas import SCHEMAS
from tidecast.sources import tables
from tidecast.sources.workspace import checkpoint_dir


def _root(b: Bound) -> str:
    return f"{checkpoint_dir(b.spark)}/tables/{uuid.uuid4().hex}"


def _stored(b: Bound, root: str, name: str):
    return tables.read_table(b.spark, f"{root}/{name}", name)


# ---- plans --------------------------------------------------------------------------------------


@case("SELECT * FROM x_daily")
def run_load_daily(b: Bound):
    root = _root(b)
    run_load(_shards(b), b.holidays, START, END, root, 7000, UNITS, [])
    return _stored(b, root, "daily_impressions")


@case(_VALIDATED)
def run_load_checks(b: Bound):
    return run_load(_shards(b), b.holidays, START, END, _root(b), 7000, UNITS, [])


@case(_ANOMALIES)
def walk_forward_anomalies(b: Bound):
    root = _root(b)
    run_walk_forward(b.daily, b.holidays, FOLDS).store(root)
    return rounded(rounded(_stored(b, root, "anomalies"), 4, "lower_bound", "upper_bound"), 6, "anomaly_probability")


@case(_DECOMPOSED)
def walk_forward_decomposition(b: Bound):
    root = _root(b)
    run_walk_forward(b.daily, b.holidays, FOLDS).store(root)
    return rounded(_stored(b, root, "forecast_decomposition"), 4, *_PARTS)


_UNITS = "(SELECT count(DISTINCT ad_unit) FROM x_train t WHERE t.fold_name = q.fold_name)"


@case(
    f"""SELECT fold_name, 'forecast_coverage' AS check, CASE WHEN count(DISTINCT model_name) = 3 AND count(DISTINCT ad_unit) = any_value({_UNITS})
    THEN 'PASS' ELSE 'FAIL' END AS status FROM x_fc_all q GROUP BY fold_name UNION ALL
    SELECT fold_name, 'metrics_completeness', CASE WHEN count(DISTINCT model_name) = 3 AND count(DISTINCT ad_unit) = any_value({_UNITS})
    AND count(DISTINCT metric_name) = 5 THEN 'PASS' ELSE 'FAIL' END FROM x_metrics_all q GROUP BY fold_name UNION ALL
    SELECT fold_name, 'no_infinite_metrics', CASE WHEN count(*) FILTER (WHERE isnan(metric_value) OR isinf(metric_value)
    OR (metric_value IS NULL AND metric_name <> 'mase')) = 0 THEN 'PASS' ELSE 'FAIL' END FROM x_metrics_all GROUP BY fold_name"""
)
def walk_forward_checks(b: Bound):
    return run_walk_forward(b.daily, b.holidays, FOLDS).checks


@case(
    " UNION ALL ".join(
        f"SELECT *, CASE WHEN status = 'PROMOTED' THEN (SELECT count(DISTINCT ad_unit) FROM x_rt_train) ELSE 0 END AS published FROM ({_RETRAINED.format(gate)})"
        for gate in ("0.0", "9.0")
    )
)
def retrain_publishes(b: Bound):
    """Once rejected and once promoted; ``published`` counts the series with published parameters."""
    daily, root, seen = b.daily_kept, _root(b), []
    for gate in (0.0, 9.0):
        verdict = rounded(retrain_and_publish(daily, b.holidays, END, f"{root}/{gate}", gate=gate), 6, "mape")
        if verdict.first()["status"] == "PROMOTED":
            series = tables.read_table(b.spark, f"{root}/{gate}/model_parameters").agg(F.count_distinct("ad_unit"))
            seen.append(verdict.withColumn("published", series.scalar()))
        else:
            seen.append(verdict.withColumn("published", F.lit(0).cast("bigint")))
    return seen[0].unionByName(seen[1])


# ---- sinks --------------------------------------------------------------------------------------


@case(f"SELECT {', '.join(_SHOWN)} FROM x_daily")
def csv_round_trip(b: Bound):
    path, shown = _root(b), b.daily.select(*_SHOWN)
    tables.export_csv(shown, path)
    return tables.load_csv(b.spark, path, shown.schema)


@case("SELECT date, wiki, ad_unit, daily_impressions, desktop_impressions, mobile_impressions FROM x_raw")
def append_typed_table(b: Bound):
    """Replaced with the first half and then extended by the second, under the declared schema."""
    root, early = _root(b), F.col("date") < F.lit("1998-06-30").cast("date")
    raw = b.raw.withColumn("daily_impressions", F.col("daily_impressions").cast("double"))
    tables.replace_table(raw.where(early), f"{root}/raw_pageviews", "raw_pageviews")
    tables.append_table(raw.where(~early), f"{root}/raw_pageviews", "raw_pageviews")
    stored = _stored(b, root, "raw_pageviews")
    assert [f.dataType for f in stored.schema] == [f.dataType for f in SCHEMAS["raw_pageviews"]]
    return stored


@case("SELECT * FROM x_raw_wide")
def create_table_as_select(b: Bound):
    return tables.ctas(b.raw_wide, f"tidecast_{uuid.uuid4().hex}", _root(b))


@case(_VALIDATED)
def fetch_rows(b: Bound):
    """Verdicts fetched row by row, as a caller reads them."""
    checks = quality.validate_daily(b.daily, 7000)
    return b.spark.createDataFrame(list(tables.to_rows(checks)), checks.schema)
