"""Registered queries, each with its SQL where SQL can state it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.bindings import Bound
from checks.sql_library import compose

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def case(sql: str | None = None):
    """Register a function of ``Bound`` under its own name."""

    def register(build: Callable[[Bound], DataFrame]):
        name = build.__name__
        assert name not in QUERIES, name
        QUERIES[name] = lambda spark, sf_dir: build(Bound(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = compose(sql)
        return build

    return register


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    """Round doubles, so that the order of summation does not show."""
    return df.withColumns({c: F.round(c, digits) for c in columns})


def as_bigint(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("bigint") for c in columns})
