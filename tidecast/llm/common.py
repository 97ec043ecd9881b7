"""Small helpers that the operators share."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidecast.sources.workspace import settle

__all__ = ["extended", "fold", "packed_rows", "place_of", "read", "settle", "text_of", "texts_of", "unpacked_rows"]

ROW = "_row"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def text_of(name: str = "text") -> Column:
    """The text, a null one as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def fold(id_column: str, folds: int) -> Column:
    """crc32 of the id's text modulo ``folds``; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit(""))) % F.lit(folds)


def packed_rows(df: DataFrame) -> DataFrame:
    """The whole row as one struct, so that columns an operator adds can't clash with the caller's."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(ROW))


def unpacked_rows(df: DataFrame) -> DataFrame:
    return df.select(f"{ROW}.*")


def place_of(df: DataFrame, name: str) -> int:
    """The number of the column, which Spark finds in either case."""
    names = [c.lower() for c in df.columns]
    return df.columns.index(name) if name in df.columns else names.index(name.lower())


def texts_of(rows: pa.StructArray, place: int) -> list[str | None]:
    """The texts in whole rows, so that Python gets each text once."""
    texts = rows.field(place)
    return (texts if pa.types.is_string(texts.type) or pa.types.is_large_string(texts.type) else texts.cast(pa.string())).to_pylist()


def extended(df: DataFrame, columns: str) -> T.StructType:
    """The schema of ``df`` with columns added, given as in "name type, ..."."""
    return T.StructType(df.schema.fields + T.StructType.fromDDL(columns).fields)
