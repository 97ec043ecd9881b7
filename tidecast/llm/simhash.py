"""Near-duplicates by SimHash, with links found through pivot distance tables.

A fingerprint has a bit set where over half of the text's shingle hashes have it. Two fingerprints link
when at most ``distance`` bits differ. Links are sought among distinct fingerprints only:

1. The 64 bits are cut into ``BLOCKS`` = 7 blocks. As at most 4 bits differ, some 3 blocks are equal, so
   every linked pair meets under one of the 35 keys "these 3 blocks (27-28 bits) have these values".
2. Under each key, the Hamming distances of its fingerprints to ``PIVOTS`` reference fingerprints form a
   table. By the triangle inequality a pair whose rows differ by more than ``distance`` in any
   coordinate can't link and is discarded; only survivors are verified bit by bit.
3. A key gives at most one edge per fingerprint (a spanning forest of its links), never all pairs, and
   the components of these edges are found by contraction.

Scale: keys are dealt by hash and sorted, so a task holds one key's fingerprints at a time. A key with
more than ``HOT`` fingerprints is deferred: its rows are cut into chunks and each pair of chunks is a
task's work of its own. Identical fingerprints are one node, so copies cost nothing here.

Defined cases: null text counts as empty; a text without words has fingerprint zero, which links as any
other; fewer words than a shingle make one shingle; a null id counts last for the smallest id; repeated
ids stay separate rows; an empty table gives an empty result.
"""

from __future__ import annotations

from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidecast.llm.common import ROW, packed_rows, settle, text_of, unpacked_rows
from tidecast.llm.components import connected_components
from tidecast.llm.exact_dedup import bits_for, may_repeat, repeated_bitmap

SHINGLE = 4
DISTANCE = 4
BLOCKS = 7
PIVOTS = 16
HOT = 8192
SEED = 42  # of the shingle hash

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_SEGMENT = 1 << 16


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The 64-bit fingerprint of a whole text."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8").translate(_LOWER).split()
    if not words:
        return 0
    whole = b" ".join(words)
    if len(words) <= shingle:
        return xxh64_intdigest(whole, SEED)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends]
    n, ones = len(words) - shingle + 1, np.zeros(64, dtype=np.int64)
    for at in range(0, n, _SEGMENT):
        z = min(n, at + _SEGMENT)
        hashes = [xxh64_intdigest(whole[a : e - 1], SEED) for a, e in zip(starts[at:z], ends[at + shingle - 1 : z + shingle - 1])]
        bits = np.unpackbits(np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(sum(1 << k for k in np.flatnonzero(2 * ones > n).tolist()))


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id, fp) of every document; fp is the fingerprint as a signed long."""

    def work(batches):
        for batch in batches:
            found = np.array([fingerprint(t, shingle) for t in batch.column(1).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], ["id", "fp"])

    return docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text")).mapInArrow(work, "id long, fp long")


def _block_masks(blocks: int, distance: int) -> list[int]:
    """The bits kept by each choice of ``blocks - distance`` blocks, as signed longs."""
    edges = [round(64 * k / blocks) for k in range(blocks + 1)]
    of = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]
    masks = [sum(chosen) for chosen in combinations(of, blocks - distance)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _pivots(count: int = PIVOTS) -> np.ndarray:
    return np.random.default_rng(64).integers(0, 1 << 64, count, dtype=np.uint64)


def pivot_table(fps: np.ndarray) -> np.ndarray:
    """Hamming distances of each fingerprint to the reference fingerprints."""
    return np.bitwise_count(fps[:, None] ^ _pivots()[None, :]).astype(np.int8)


def linked(row: int, among: np.ndarray, fps: np.ndarray, table: np.ndarray, distance: int) -> np.ndarray:
    """Of the indexes ``among``, those that link to ``row``: discarded by the table, then verified."""
    for k in range(table.shape[1]):  # coordinate by coordinate, so that each sees what the last left
        among = among[np.abs(table[among, k] - table[row, k]) <= distance]
        if not len(among):
            return among
    return among[np.bitwise_count(fps[among] ^ fps[row]) <= distance]


def forest(fps: np.ndarray, side: np.ndarray | None, distance: int) -> list[tuple[int, int]]:
    """Edges (indexes) that join what links; with ``side``, links between side 0 and side 1 count only."""
    table, labels, out = pivot_table(fps), np.arange(len(fps)), []
    for row in range(1, len(fps)):
        among = np.arange(row)
        among = among[labels[:row] != labels[row]]
        if side is not None:
            among = among[side[among] != side[row]]
        found = linked(row, among, fps, table, distance)
        if len(found):
            _, first = np.unique(labels[found], return_index=True)
            for other in found[first].tolist():
                out.append((other, row))
                labels[labels == labels[other]] = labels[row]
    return out


def _pairs(fps: np.ndarray, starts: np.ndarray, distance: int) -> np.ndarray:
    """Indexes of the groups of two whose members link."""
    a, b = fps[starts], fps[starts + 1]
    near = np.abs(pivot_table(a) - pivot_table(b)).max(axis=1, initial=0) <= distance
    return starts[near & (np.bitwise_count(a ^ b) <= distance)]


EDGES = "a long, b long, combo int, key long, chunk int"


def _edges(a, b) -> pa.RecordBatch:
    n = len(a)
    none = [pa.nulls(n, t) for t in (pa.int32(), pa.int64(), pa.int32())]
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), *none], ["a", "b", "combo", "key", "chunk"])


def _starts(*keys: np.ndarray) -> np.ndarray:
    """Where groups of equal keys begin."""
    change = np.zeros(len(keys[0]), dtype=bool)
    change[0] = True
    for k in keys:
        change[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(change)


def _deferred(rows: list[np.ndarray], sent: int, hot: int) -> pa.RecordBatch:
    """Rows of a hot key, each with the number of its chunk."""
    combo, key, fps = rows
    chunk = ((np.arange(len(fps)) + sent) // hot).astype(np.int32)
    return pa.RecordBatch.from_arrays(
        [pa.array(fps), pa.nulls(len(fps), pa.int64()), pa.array(combo), pa.array(key), pa.array(chunk)], ["a", "b", "combo", "key", "chunk"]
    )


def _link_keys(rows: list[np.ndarray], distance: int, hot: int):
    """Edges within each whole key of the rows."""
    combo, key, signed = rows
    fps = signed.view(np.uint64)
    starts = _starts(combo, key)
    sizes = np.diff(np.append(starts, len(fps)))
    two = _pairs(fps, starts[sizes == 2], distance)
    yield _edges(signed[two], signed[two + 1])
    for a, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
        if n > hot:
            yield _deferred([x[a : a + n] for x in rows], 0, hot)
        elif found := forest(fps[a : a + n], None, distance):
            yield _edges([signed[a + x] for x, _ in found], [signed[a + y] for _, y in found])


def _link_sorted(distance: int, hot: int):
    """Over rows (combo, key, fp) sorted by key: edges, and the rows of hot keys with their chunk."""

    def work(batches):
        tail = hot_key = None  # the rows of the last key so far, or the key whose rows go out as they come
        sent = 0
        for batch in batches:
            rows = [batch.column(k).to_numpy() for k in range(3)]
            if hot_key is not None:
                n = int(((rows[0] == hot_key[0]) & (rows[1] == hot_key[1])).sum())
                if n:
                    yield _deferred([x[:n] for x in rows], sent, hot)
                    sent, rows = sent + n, [x[n:] for x in rows]
                if not len(rows[2]):
                    continue
                hot_key = None
            if tail is not None:
                rows = [np.concatenate(p) for p in zip(tail, rows)]
            if not len(rows[2]):
                continue
            cut = int(_starts(rows[0], rows[1])[-1])
            if cut:
                yield from _link_keys([x[:cut] for x in rows], distance, hot)
            tail = [x[cut:] for x in rows]
            if len(tail[2]) > hot:
                yield _deferred(tail, 0, hot)
                hot_key, sent, tail = (tail[0][0], tail[1][0]), len(tail[2]), None
        if tail is not None:
            yield from _link_keys(tail, distance, hot)

    return work


def _link_chunks(distance: int):
    """Edges within each cell (two chunks of a hot key, or one with itself) of sorted rows (combo, key, lo, hi, side, fp)."""

    def cell(rows):
        fps = rows[5].view(np.uint64)
        found = forest(fps, rows[4] if rows[2][0] != rows[3][0] else None, distance)
        return _edges([rows[5][x] for x, _ in found], [rows[5][y] for _, y in found])

    def work(batches):
        tail = None
        for batch in batches:
            rows = [batch.column(k).to_numpy() for k in range(6)]
            if tail is not None:
                rows = [np.concatenate(p) for p in zip(tail, rows)]
            if not len(rows[5]):
                continue
            starts = _starts(*rows[:4]).tolist()
            for a, z in zip(starts, starts[1:]):
                yield cell([x[a:z] for x in rows])
            tail = [x[starts[-1] :] for x in rows]
        if tail is not None:
            yield cell(tail)

    return work


def link_edges(nodes: DataFrame, distance: int = DISTANCE, blocks: int = BLOCKS, hot: int = HOT) -> DataFrame:
    """Edges (a, b) whose components are those of all links among the distinct ``fp`` of ``nodes``."""
    keys = [F.struct(F.lit(k).alias("combo"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for k, m in enumerate(_block_masks(blocks, distance))]
    filed = nodes.select(F.explode(F.array(*keys)).alias("k"), "fp").select("k.combo", "k.key", "fp")
    sorted_keys = filed.repartition("combo", "key").sortWithinPartitions("combo", "key", "fp")
    found = settle(sorted_keys.mapInArrow(_link_sorted(distance, hot), EDGES))
    edges = found.filter("chunk IS NULL").select("a", "b")
    late = found.filter("chunk IS NOT NULL").select("combo", "key", "chunk", F.col("a").alias("fp"))
    if late.isEmpty():
        return edges
    chunks = settle(late.groupBy("combo", "key").agg((F.max("chunk") + 1).alias("n")))
    paired = late.join(chunks, ["combo", "key"]).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    cells = paired.select(
        "combo",
        "key",
        F.least("chunk", "other").alias("lo"),
        F.greatest("chunk", "other").alias("hi"),
        (F.col("chunk") > F.col("other")).cast("int").alias("side"),
        "fp",
    )
    where = ["combo", "key", "lo", "hi"]
    more = cells.repartition(*where).sortWithinPartitions(*where, "side", "fp").mapInArrow(_link_chunks(distance), EDGES)
    return edges.unionByName(more.select("a", "b"))


def near_duplicate_groups(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", shingle: int = SHINGLE, distance: int = DISTANCE, hot: int = HOT) -> DataFrame:
    """A row per document: id, fp, component (the smallest id reachable over links)."""
    rows = settle(fingerprints(docs, id_column, text_column, shingle))
    nodes = settle(rows.groupBy("fp").agg(F.min("id").alias("least")))
    roots = connected_components(link_edges(nodes.select("fp"), distance, hot=hot))
    members = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    least = members.groupBy("root").agg(F.min("least").alias("component"))
    of = settle(members.join(least, "root").select("fp", "component"))
    return rows.join(of, "fp").select("id", "fp", "component")


def hex_of(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def drop_near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The documents with all their columns, one of each group: the one with the smallest id (null last), then mark.

    Rows are told apart by id and a 64-bit mark of the text, so another row with a removed one's id (or a null id as
    well) stays; of rows equal in both, one stays. Only rows whose mark may be one of a group of two or more, by a
    Bloom filter, are shuffled.
    """
    mark = F.xxhash64
    texts = docs.select(mark(text_of(text_column)).alias("mark"), F.col(text_column).alias("text"))
    groups = near_duplicate_groups(texts, "mark", "text").select(F.col("id").alias("sha"), "component").distinct()
    rows = docs.select(F.col(id_column).cast("long").alias("id"), mark(text_of(text_column)).alias("sha"))
    found = settle(rows.join(groups, "sha"))
    own = F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("sha").alias("sha"))
    shared = settle(found.groupBy("component").agg(F.min(own).alias("least"), F.count(F.lit(1)).alias("n")).filter("n > 1"))
    stays = F.col("id").eqNullSafe(F.col("least.id")) & (F.col("sha") == F.col("least.sha"))
    marked = settle(found.join(shared, "component").groupBy(F.col("id").alias("_other"), F.col("sha").alias("_sha")).agg(F.max(stays).alias("_stays")))
    bits = bits_for(marked.count())
    possible = may_repeat("_mark", repeated_bitmap(marked, "_sha", bits, least=1), bits)
    whole = packed_rows(docs).select(ROW, F.col(f"{ROW}.{id_column}").cast("long").alias("_id"), mark(text_of(f"{ROW}.{text_column}")).alias("_mark"))
    joined = whole.filter(possible).join(marked, (F.col("_mark") == F.col("_sha")) & F.col("_id").eqNullSafe(F.col("_other")), "left")
    alone = joined.filter("_stays IS NULL").select(ROW)
    first = joined.filter("_stays").dropDuplicates(["_id", "_mark"]).select(ROW)
    return unpacked_rows(whole.filter(~possible).select(ROW).unionByName(alone).unionByName(first))
