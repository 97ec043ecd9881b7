"""Exact quantiles of large groups without gathering a group in one task.

``percentile`` keeps every distinct value of a group in one aggregation buffer, and a ranking
window sorts the whole group in one task. Here a bounded sketch first brackets each quantile;
then counting places the bracket, and only the values inside it, with the nearest one on each
side, are grouped and ordered. The passes over all rows keep a few numbers per group and neither
shuffle nor sort the rows. A rank outside the bracket would be an error, not a NULL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidecast.sources.workspace import settle

# The sketch's rank error is 1/ACCURACY of the group; the bracket is five times as wide.
ACCURACY = 10_000
MARGIN = 5.0 / ACCURACY


def exact_quantiles(df: DataFrame, value: str, quantiles: dict[str, float], by: list[str]) -> DataFrame:
    """Linearly interpolated quantiles, one row per group: ``by``, ``n`` and one column per name.

    One path at every group size. No group columns means one quantile over all rows.
    """
    present = settle(df.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("v")))

    def with_group(rows, per_group):
        """``rows`` with the row of their group as the struct ``b``."""
        packed = per_group.select(*by, F.struct(*[c for c in per_group.columns if c not in by]).alias("b"))
        return rows.join(packed, by) if by else rows.withColumn("b", packed.scalar())

    marks = {
        name: (
            F.percentile_approx("v", max(q - MARGIN, 0.0), ACCURACY).alias(f"low {k}"),
            F.percentile_approx("v", min(q + MARGIN, 1.0), ACCURACY).alias(f"high {k}"),
        )
        for k, (name, q) in enumerate(quantiles.items())
    }
    # Settled, so that the optimizer joins a row per group by its measured size.
    summary = settle(present.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[m for pair in marks.values() for m in pair]))
    v, places = F.col("v"), []
    for k, (name, q) in enumerate(quantiles.items()):
        low, high = F.col(f"b.low {k}"), F.col(f"b.high {k}")
        places.append(
            F.struct(
                F.lit(name).alias("name"),
                F.max(low).alias("low"),
                F.count_if(v < low).alias("below"),
                F.coalesce(F.max(F.when(v < low, v)), F.max(low)).alias("least"),
                F.coalesce(F.min(F.when(v > high, v)), F.max(high)).alias("most"),
                (F.lit(q) * (F.max("b.n") - 1)).alias("position"),
            )
        )
    sides = settle(with_group(present, summary).groupBy(*by).agg(F.max("b.n").alias("n"), F.array(*places).alias("places")))
    group = [*by, "name"]
    inside = (
        with_group(present, sides)
        .select(*by, "v", F.col("b.n").alias("n"), F.inline("b.places"))
        .where(v.between(F.col("least"), F.col("most")))
        .groupBy(*group, "v", "n", "low", "below", "position")
        .agg(F.count(F.lit(1)).alias("c"))
        .withColumn("through", F.sum("c").over(Window.partitionBy(*group).orderBy("v")))
        .withColumn("under", F.sum(F.when(v < F.col("low"), F.col("c")).otherwise(0)).over(Window.partitionBy(*group)))
    )
    # A value covers the zero-based ranks [last - c, last).
    last = F.col("below") - F.col("under") + F.col("through")

    def at(rank):
        found = F.max(F.when((rank >= last - F.col("c")) & (rank < last), F.col("v")))
        return F.coalesce(found, F.raise_error(F.lit("a quantile lies outside its bracket")).cast("double"))

    position = F.col("position")
    picked = (
        inside.groupBy(*group)
        .agg(
            F.first("n").alias("n"),
            F.first("position").alias("position"),
            at(F.floor(position)).alias("at_floor"),
            at(F.ceil(position)).alias("at_ceil"),
        )
        .withColumn(
            "quantile",
            F.col("at_floor") + (F.col("at_ceil") - F.col("at_floor")) * (position - F.floor(position)),
        )
    )
    return picked.groupBy(*by).agg(
        F.first("n").alias("n"),
        *[F.max(F.when(F.col("name") == name, F.col("quantile"))).alias(name) for name in quantiles],
    )
