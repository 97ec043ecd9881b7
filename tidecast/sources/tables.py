"""Reading and writing the stored tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from tidecast.schemas import LAYOUT, SCHEMAS
from tidecast.sources.workspace import settle


def load_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Headed CSV with a declared schema; a malformed row is an error, not a NULL."""
    return spark.read.csv(path, header=True, schema=schema, mode="FAILFAST")


def export_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def read_table(spark: SparkSession, path: str, name: str | None = None) -> DataFrame:
    """A stored table; with ``name``, under its declared schema and in its column order."""
    if name is None:
        return spark.read.parquet(path)
    return spark.read.schema(SCHEMAS[name]).parquet(path).select(*SCHEMAS[name].names)


def conform(df: DataFrame, name: str) -> DataFrame:
    """Select and cast to the declared columns of a table."""
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in SCHEMAS[name].fields])


def _write(df: DataFrame, keys: list[str], sort_by: list[str]):
    if keys:
        # Rebalance brings the rows of a folder together and splits a folder that is too large for
        # one task, so there are neither many small files nor one hot writer.
        df = df.hint("rebalance", *[F.col(k) for k in keys])
    if keys or sort_by:
        df = df.sortWithinPartitions(*keys, *sort_by)
    writer = df.write
    return writer.partitionBy(*keys) if keys else writer


def replace_table(df: DataFrame, path: str, name: str | None = None, partitions: list[str] | None = None) -> None:
    """Replace a whole table, laid out as declared. The commit is atomic, unlike delete + insert."""
    declared, sort_by = LAYOUT.get(name, ([], []))
    keys = declared if partitions is None else partitions
    if name:
        df = conform(df, name)
    _write(df, keys, sort_by).mode("overwrite").parquet(path)


def append_table(df: DataFrame, path: str, name: str | None = None, partitions: list[str] | None = None) -> None:
    declared, sort_by = LAYOUT.get(name, ([], []))
    keys = declared if partitions is None else partitions
    _write(conform(df, name) if name else df, keys, sort_by).mode("append").parquet(path)


def replace_scope(df: DataFrame, path: str, keys: list[str], scope: Column, name: str | None = None) -> None:
    """Replace the partitions of a table that ``scope`` selects, and no other.

    ``keys`` are the partition columns and ``scope`` a condition on them alone. A partition in
    scope without new rows is emptied: dynamic overwrite would keep its old rows. Its folder is
    taken from its files, never built from the value. The new rows are settled first, so ``df`` may
    be derived from the same table. New rows come first and emptied partitions last; a run that
    is cut off between the two is completed by running it again.
    """
    spark = df.sparkSession
    _, sort_by = LAYOUT.get(name, ([], []))
    fresh = settle(df.where(scope))
    stale = None
    try:
        stored = spark.read.schema(df.schema).parquet(path).where(scope)
        folder = F.regexp_replace(F.col("_metadata.file_path"), "/[^/]+$", "").alias("folder")
        new = fresh.select(*[F.col(k).alias(f"new_{k}") for k in keys]).distinct()
        same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"new_{k}")) for k in keys])
        stale = settle(stored.select(*keys, folder).distinct().join(new, same, "left_anti").select("folder"))
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
    _write(fresh, keys, sort_by).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
    if stale is not None:
        # One metadata call per emptied partition; the names come one part at a time.
        for row in stale.toLocalIterator():
            _remove_folder(spark, row["folder"])


def _remove_folder(spark: SparkSession, folder: str) -> None:
    """``folder`` as Spark names it in file paths: an encoded URI."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(folder))
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def ctas(df: DataFrame, table: str, path: str | None = None) -> DataFrame:
    """Create or replace a catalog table from a query, stored at ``path`` or, without one, in the warehouse."""
    writer = df.write.mode("overwrite").format("parquet")
    (writer.option("path", path) if path else writer).saveAsTable(table)
    return df.sparkSession.table(table)


def insert_missing(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """``target`` plus the rows of ``source`` whose keys it does not hold."""
    absent = source.join(target.select(*keys), keys, "left_anti")
    return target.unionByName(absent.select(*target.columns))


def extend_dimension(dim: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """A dimension plus the new rows whose key it lacks."""
    return insert_missing(dim, new, [key])


def recent(df: DataFrame, days: int, as_of, date_col: str = "date") -> DataFrame:
    """Rows from ``as_of - days`` on; the reference date is given, so a rerun sees the same rows."""
    return df.where(F.col(date_col) >= F.date_sub(F.lit(as_of).cast("date"), days))


def window_slice(df: DataFrame, start, end, date_col: str = "date") -> DataFrame:
    return df.where(F.col(date_col).between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def date_filter(df: DataFrame, start=None, end=None, date_col: str = "date") -> DataFrame:
    """Zero, one or two date bounds."""
    bounds = []
    if start is not None:
        bounds.append(F.col(date_col) >= F.lit(start).cast("date"))
    if end is not None:
        bounds.append(F.col(date_col) <= F.lit(end).cast("date"))
    return df.where(reduce(lambda a, b: a & b, bounds)) if bounds else df


def spot_check(df: DataFrame, keys: list[str], n: int = 10, seed: int = 0) -> DataFrame:
    """``n`` random rows; a top-n by hashed key, so no task sorts the whole table.

    The same seed gives the same rows however the table is partitioned.
    """
    named = F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys])
    return df.orderBy(F.md5(named), *keys).limit(n)


def sample_rows(df: DataFrame, condition: Column, order: list[str], n: int = 10) -> DataFrame:
    """The first ``n`` rows that meet a condition."""
    return df.where(condition).orderBy(*order).limit(n)


def profile_table(df: DataFrame) -> DataFrame:
    """One row per column: position, type, table rows and non-NULL values, in one pass."""
    entries = [
        F.struct(
            F.lit(i).cast("bigint").alias("position"),
            F.lit(f.name).alias("column_name"),
            F.lit(f.dataType.simpleString()).alias("data_type"),
            F.count(F.col(f.name)).alias("non_null"),
        )
        for i, f in enumerate(df.schema.fields, 1)
    ]
    one = df.agg(F.count(F.lit(1)).alias("row_count"), F.array(*entries).alias("columns"))
    return one.select(F.explode("columns").alias("c"), "row_count").select("c.*", "row_count")


def to_rows(df: DataFrame):
    """Rows one partition at a time; for small results such as verdicts."""
    return (row.asDict() for row in df.toLocalIterator())


def run_sql(spark: SparkSession, text: str, args: dict, **frames: DataFrame) -> DataFrame:
    """SQL over named frames with named scalar or list parameters, never spliced into the text."""
    return spark.sql(text, args=args, **frames)
