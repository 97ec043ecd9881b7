"""The trie of conversation prefixes, by van Emde Boas recursion.

A trie over sequences of up to 2 ** k turns is cut at half its depth. Each sequence's upper half is named, equal
halves alike; the name of the cut prefix is the root of the lower tree that the other half belongs to. The upper
trie and all lower trees, now of half the depth, are cut in the same way side by side, so that after k rounds every
prefix has a name made of the names of its power-of-two parts:

    name(prefix of d turns) = H(name(prefix of d - 2 ** j turns), name(block of the last 2 ** j turns))

with 2 ** j the lowest set bit of d. Totals are grafted upward in the same cuts. Going up, the total of a tree of
depth 2 ** k is that of its upper trie plus those of the lower trees hanging from the cut nodes; going down, what
hangs below a cut node is the total of its own lower tree plus what hangs below that tree's last nodes.

Scale: each round is a join or an aggregation on distinct keys over the blocks or nodes of that depth, whose number
halves from round to round, so all rounds together handle about twice the turns, in as many rounds as the longest
conversation's length has binary digits. Texts are digested where they are read and never shuffled. A conversation
with a third of all turns is dealt over many tasks: turns are numbered by range partitions and their counts. A node
with a third of all conversations is combined on the map side; the ids that end there are joined to pieces of
``IDS`` before one task streams the pieces into the digest.

Defined cases: rows without conv_id belong to no conversation; null role and text count as empty; turns with equal
numbers are ordered by their digest, and each counts; an empty table has no root and gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidecast.llm.common import settle, text_of

IDS = 4096
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def _name(of: Column) -> Column:
    return F.unhex(F.substring(F.sha2(of, 256), 1, 32))


def _joined(a: str, b: str) -> Column:
    return _name(F.concat(F.col(a), F.col(b)))


def _turns(conversations: DataFrame) -> DataFrame:
    role, text = text_of("role"), text_of("text")
    told = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary")
    rows = conversations.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        _name(told).alias("name"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"),
    )
    return rows.withColumn("tie", F.monotonically_increasing_id())


def _local_places(batches):
    """Over rows sorted by conversation: the task and the row's place among those of its conversation there."""
    part, last, seen = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        ids = batch.column(0).to_numpy()
        if not len(ids):
            continue
        starts = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
        place = np.arange(len(ids)) - np.repeat(starts, np.diff(np.append(starts, len(ids))))
        if last is not None and ids[0] == last:
            place[: starts[1] if len(starts) > 1 else len(ids)] += seen
        last, seen = int(ids[-1]), int(place[-1]) + 1
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), batch.column(2), pa.array(np.full(len(ids), part, dtype=np.int32)), pa.array(place)], ["conv_id", "name", "words", "part", "place"]
        )


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, name, words) of every turn, pos from 0; no task needs all turns of a conversation."""
    order = ["conv_id", "turn", "name", "tie"]
    dealt = _turns(conversations).repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "name", "words")
    local = settle(dealt.mapInArrow(_local_places, "conv_id long, name binary, words long, part int, place long"))
    counts = local.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = settle(counts.withColumn("skip", F.sum("n").over(before)).filter("skip IS NOT NULL").select("conv_id", "part", "skip"))
    return local.join(offsets, ["conv_id", "part"], "left").select("conv_id", (F.col("place") + F.coalesce("skip", F.lit(0))).alias("pos"), "name", "words")


def rebuilt(turns: DataFrame, group: int = 20, heads: int = 4) -> tuple[DataFrame, DataFrame]:
    """(conv_id, pos, name, words) and (conv_id, len) of the rebuilt conversations.

    The first h = crc32(conv_id) mod ``heads`` turns are those of conversation conv_id - conv_id % ``group``.
    """
    turns = settle(turns)
    own = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("own"))
    own = own.withColumn("h", F.crc32(F.col("conv_id").cast("string")) % heads).withColumn("base", F.col("conv_id") - F.col("conv_id") % group)
    first = turns.filter((F.col("pos") < heads - 1) & (F.col("conv_id") % group == 0)).groupBy(F.col("conv_id").alias("base"))
    plan = own.join(first.agg(F.sort_array(F.collect_list(F.struct("pos", "name", "words"))).alias("first")), "base", "left")
    plan = settle(plan.withColumn("given", F.least("h", F.coalesce(F.size("first"), F.lit(0)))))  # size(null) is null
    head = plan.filter("given > 0").select("conv_id", F.explode(F.slice("first", F.lit(1), F.col("given").cast("int"))).alias("t")).select("conv_id", "t.*")
    rest = turns.join(plan.select("conv_id", "h", "given"), "conv_id").filter("pos >= h")
    rest = rest.select("conv_id", (F.col("pos") - F.col("h") + F.col("given")).alias("pos"), "name", "words")
    lengths = plan.select("conv_id", (F.col("given") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("len"))
    return settle(head.unionByName(rest)), lengths


def _blocks(turns: DataFrame, levels: int) -> list[DataFrame]:
    """Per level k the names (conv_id, at, name) of all whole blocks of 2 ** k turns that begin at a multiple of that."""
    out = [turns.select("conv_id", F.col("pos").alias("at"), "name")]
    for k in range(levels - 1):
        second = F.col("at").bitwiseAND(1 << k) != 0
        halves = out[-1].groupBy("conv_id", F.shiftright("at", k + 1).alias("pair")).agg(F.max(F.when(~second, F.col("name"))).alias("a"), F.max(F.when(second, F.col("name"))).alias("b"))
        whole = halves.filter("a IS NOT NULL AND b IS NOT NULL")
        out.append(settle(whole.select("conv_id", F.shiftleft("pair", k + 1).alias("at"), _joined("a", "b").alias("name"))))
    return out


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def prefix_names(turns: DataFrame, lengths: DataFrame, levels: int) -> DataFrame:
    """(conv_id, at, len, node) for each of a conversation's prefixes of at = 0 .. len turns."""
    blocks = _blocks(turns, levels)
    parts = [settle(lengths.select("conv_id", F.lit(0).cast("long").alias("at"), "len", F.unhex(F.lit("00" * 16)).alias("node")))]
    for k in range(levels, 0, -1):  # trees of depth 2 ** k are cut at half
        half = 1 << (k - 1)
        upper = blocks[k - 1].filter(F.col("at").bitwiseAND(half) == 0)
        cut = _union(parts).filter(F.col("at") + half <= F.col("len")).join(upper, ["conv_id", "at"])
        parts.append(settle(cut.select("conv_id", (F.col("at") + half).alias("at"), "len", _joined("node", "name").alias("node"))))
    return _union(parts)


SUMS = ["leaves", "saved"]


def _added(rows: DataFrame) -> DataFrame:
    return settle(rows.groupBy("node").agg(F.max("depth").alias("depth"), *[F.sum(c).alias(c) for c in SUMS]))


def grafted(nodes: DataFrame, links: DataFrame, levels: int) -> DataFrame:
    """(node, leaves, saved) summed over all that hangs below each node; nodes with nothing below are left out.

    ``links`` (node, depth, j, up) leads each node to its ancestors 2 ** j above, for all j up to its depth's lowest set bit.
    """
    lowest = F.col("depth").bitwiseAND(-F.col("depth"))

    def lifted(values: DataFrame, j: int, which: Column) -> DataFrame:
        """The values of nodes, at their ancestors 2 ** j above."""
        through = links.filter((F.col("j") == j) & which).select("node", F.col("depth") - (1 << j), "up").toDF("node", "above", "up")
        return through.join(values, "node").select(F.col("up").alias("node"), F.col("above").alias("depth"), *SUMS)

    trees = [_added(lifted(nodes.select("node", *SUMS), 0, F.lit(True)))]
    for k in range(1, levels + 1):
        upper = trees[-1].filter(F.col("depth") % (1 << k) == 0)
        trees.append(_added(upper.unionByName(lifted(trees[-1].drop("depth"), k - 1, lowest == (1 << (k - 1))))))
    below = [trees[-1].filter("depth = 0")]
    for k in range(levels, 0, -1):
        half = 1 << (k - 1)
        own = trees[k - 1].filter((F.col("depth") > 0) & (lowest == half))
        below.append(_added(own.unionByName(lifted(_union(below).drop("depth"), k - 1, lowest > half))))
    return _union(below).drop("depth")


def _id_pieces(batches):
    """Over rows (node, conv_id) sorted by both: per node the ids joined by commas, ``IDS`` at most in a piece."""
    node, ids = None, []
    for batch in batches:
        out = []
        for n, i in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if ids and (n != node or len(ids) == IDS):
                out.append((node, ids[0], ",".join(map(str, ids))))
                ids = []
            node = n
            ids.append(i)
        if out:
            yield _pieces(out)
    if ids:
        yield _pieces([(node, ids[0], ",".join(map(str, ids)))])


def _pieces(rows: list[tuple]) -> pa.RecordBatch:
    node, first, text = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(node, pa.binary()), pa.array(first, pa.int64()), pa.array(text, pa.string())], ["node", "first", "ids"])


def _streamed_digests(batches):
    """Over pieces sorted by node and first id: the SHA-256 of each node's pieces joined by commas."""
    node, digest = None, None
    for batch in batches:
        out = []
        for n, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if n != node:
                if digest is not None:
                    out.append((node, digest.hexdigest()))
                node, digest = n, hashlib.sha256(text.encode())
            else:
                digest.update(b"," + text.encode())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.binary()), pa.array([y for _, y in out])], ["node", "ends_sha256"])
    if digest is not None:
        yield pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([digest.hexdigest()])], ["node", "ends_sha256"])


def end_digests(paths: DataFrame) -> DataFrame:
    """(node, ends_sha256) of the nodes where conversations end."""
    ended = paths.filter("at = len").select("node", "conv_id").repartitionByRange("node", "conv_id").sortWithinPartitions("node", "conv_id")
    pieces = settle(ended.mapInArrow(_id_pieces, "node binary, first long, ids string"))
    ordered = pieces.repartition("node").sortWithinPartitions("node", "first").select("node", "ids")
    return ordered.mapInArrow(_streamed_digests, "node binary, ends_sha256 string")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """A row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    turns, lengths = rebuilt(numbered_turns(conversations))
    levels = int(lengths.agg(F.coalesce(F.max("len"), F.lit(0)).alias("n")).first()["n"]).bit_length()
    paths = prefix_names(turns, lengths, levels)
    seen = settle(paths.groupBy("node").agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id"), F.max("at").alias("depth")))
    steps = F.explode(F.sequence(F.lit(0), F.bit_count(F.expr("(depth & -depth) - 1")))).alias("j")
    wanted = seen.filter("depth > 0").select("node", "conv_id", "depth", steps).withColumn("at", F.expr("depth - shiftleft(1L, j)"))
    links = settle(wanted.join(paths.select("conv_id", "at", F.col("node").alias("up")), ["conv_id", "at"]).select("node", "depth", "j", "up"))
    parents = links.filter("j = 0").select("node", "up")
    children = parents.groupBy(F.col("up").alias("node")).agg(F.count(F.lit(1)).alias("n_children"))
    last = turns.select("conv_id", (F.col("pos") + 1).alias("depth"), "words")
    nodes = seen.join(last, ["conv_id", "depth"], "left").join(children, "node", "left").select(
        "node",
        "conv_id",
        "depth",
        "n_convs",
        F.coalesce("n_children", F.lit(0)).alias("n_children"),
        F.col("n_children").isNull().cast("long").alias("leaves"),
        ((F.col("n_convs") - 1) * F.coalesce("words", F.lit(0))).alias("saved"),
    )
    nodes = settle(nodes)
    below = grafted(nodes, links, levels).select("node", F.col("leaves").alias("more_leaves"), F.col("saved").alias("more_saved"))
    above = parents.join(nodes.select(F.col("node").alias("up"), F.col("conv_id").alias("parent_conv_id")), "up").select("node", "parent_conv_id")
    whole = nodes.join(below, "node", "left").join(end_digests(paths), "node", "left").join(above, "node", "left")
    return whole.select(
        "conv_id",
        "depth",
        "parent_conv_id",
        "n_convs",
        "n_children",
        (F.col("leaves") + F.coalesce("more_leaves", F.lit(0))).alias("n_leaves"),
        (F.col("saved") + F.coalesce("more_saved", F.lit(0))).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(EMPTY_SHA)).alias("ends_sha256"),
    )
