"""Walk-forward folds as data: all folds go through one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidecast.config import Fold


def _literals(folds: list[Fold]):
    return F.array(
        *[
            F.struct(
                F.lit(f.name).alias("fold_name"),
                F.lit(f.train_start).alias("train_start"),
                F.lit(f.train_end).alias("train_end"),
                F.lit(f.test_start).alias("test_start"),
                F.lit(f.test_end).alias("test_end"),
            )
            for f in folds
        ]
    )


def in_fold(df: DataFrame, folds: list[Fold], part: str, date_col: str = "date") -> DataFrame:
    """Rows of the ``train`` or ``test`` window of each fold, tagged with ``fold_name``.

    A row is emitted once per fold whose window holds it; no join. The outer bounds are also
    stated alone, so they reach the scan.
    """
    first = min(getattr(f, f"{part}_start") for f in folds)
    last = max(getattr(f, f"{part}_end") for f in folds)
    held = F.filter(
        _literals(folds), lambda f: F.col(date_col).between(f[f"{part}_start"], f[f"{part}_end"])
    )
    names = F.transform(held, lambda f: f["fold_name"])
    return df.where(F.col(date_col).between(F.lit(first), F.lit(last))).withColumn("fold_name", F.explode(names))


def walk_forward_splits(df: DataFrame, folds: list[Fold]) -> DataFrame:
    """Rows tagged with ``fold_name`` and ``split`` (train or test)."""
    parts = [in_fold(df, folds, part).withColumn("split", F.lit(part)) for part in ("train", "test")]
    return parts[0].unionByName(parts[1])


def with_fold_dates(df: DataFrame, folds: list[Fold], *bounds: str) -> DataFrame:
    """Attach fold bounds such as ``test_start`` to rows that carry ``fold_name``."""
    for bound in bounds:
        by_name = F.create_map(*[F.lit(x) for f in folds for x in (f.name, getattr(f, bound))])
        df = df.withColumn(bound, by_name[F.col("fold_name")])
    return df
