"""Where intermediate tables go."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; a temporary one only in local mode."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tidecast-"))
    return spark.sparkContext.getCheckpointDir()


def settle(df: DataFrame, sort_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    The returned frame has no lineage to recompute, survives lost executors, and is still pruned
    and filtered at the scan. Use it where several later branches read the same result.
    """
    path = f"{checkpoint_dir(df.sparkSession)}/settled/{uuid.uuid4().hex}"
    out = df.sortWithinPartitions(*sort_by) if sort_by else df
    out.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
