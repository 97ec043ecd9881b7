"""Connected components of an edge table, by repeated contraction.

In each round every node takes the least of itself and its neighbours, edges are mapped to these and
become loops or edges among fewer nodes. The number of rounds grows with the logarithm of the nodes.
Each round's map is written to the shared folder, so lineage stays short and a lost executor costs at
most a round. Few edges are dealt with by few tasks. Neighbour minima are combined on the map side, so a node with very many edges is no hot key there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidecast.llm.common import settle


EDGES = 1 << 18  # a task


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", size: int | None = None) -> DataFrame:
    """(node, root) of every node that has an edge; root is the least node of its component. ``size``: the number of edges, if known."""
    edges = _clean(edges.select(F.col(a).alias("a"), F.col(b).alias("b")), size)
    rounds: list[DataFrame] = []
    while left := edges.count():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).select("node", F.least("node", "least").alias("to"))
        step = settle(step.coalesce(left // EDGES + 1))
        rounds.append(step)
        first = edges.join(step.select(F.col("node").alias("a"), F.col("to").alias("x")), "a")
        mapped = first.join(step.select(F.col("node").alias("b"), F.col("to").alias("y")), "b")
        edges = _clean(mapped.select(F.col("x").alias("a"), F.col("y").alias("b")), left)
    if not rounds:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    roots = rounds[0].select("node", F.col("to").alias("root"))
    for step in rounds[1:]:
        step = step.select(F.col("node").alias("root"), F.col("to").alias("further"))
        roots = roots.join(step, "root", "left").select("node", F.coalesce("further", "root").alias("root"))
    return settle(roots)


def _clean(edges: DataFrame, size: int | None) -> DataFrame:
    out = edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return settle(out if size is None else out.coalesce(size // EDGES + 1))
