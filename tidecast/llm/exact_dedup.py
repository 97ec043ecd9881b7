"""Exact duplicates by two-pass Bloom filtering, in DataFrame operations only.

Two texts are equal when they are identical without the characters ``[\\x20\\x09-\\x0D]``. The first
pass counts, per slot of a Bloom filter with two hash functions, how many rows fall on it; the slots
that are hit twice or more form a bitmap. In the second pass a row whose slots are not both in the
bitmap has a text of its own: it passes straight through and is never shuffled. Only the remaining
rows (the real repeats, and under 2 % of the others) are grouped exactly, by SHA-256.

Scale: the first pass shuffles one (slot, count) pair per row and hash function, combined on the map
side. The bitmap has ``BITS_PER_ROW`` bits a row, never over ``MAX_BITS`` (64 MB), so what reaches
every task has a fixed bound; beyond that many rows more of them take the exact path, with equal
results. Grouping is an aggregation with map-side combination and a join, so one text held by a third
of all rows doesn't meet in one task.

Defined cases: null text counts as empty; all texts without visible characters are equal; a null id
comes last among ties; rows repeated with id and text count one by one in ``group_size``; when
filtering, one of them stays. An empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidecast.llm.common import ROW, packed_rows, settle, text_of, unpacked_rows

WHITE_SPACE = r"[\x20\x09-\x0D]+"
BITS_PER_ROW = 16
MIN_BITS, MAX_BITS = 1 << 12, 1 << 29


def digest(text: Column) -> Column:
    """SHA-256 of the text without white space, in lowercase hex."""
    return F.sha2(F.regexp_replace(text, WHITE_SPACE, ""), 256)


def _slots(key: str, bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(F.col(key), F.lit(k)), F.lit(bits)) for k in range(2)]


def bits_for(rows: int) -> int:
    return min(MAX_BITS, max(MIN_BITS, 1 << math.ceil(math.log2(max(rows, 1) * BITS_PER_ROW))))


def repeated_bitmap(digests: DataFrame, key: str, bits: int, least: int = 2) -> DataFrame:
    """One row, one array of longs: the Bloom filter of the keys that may occur ``least`` times or more."""
    spark = digests.sparkSession
    hit = (
        digests.select(F.explode(F.array(*_slots(key, bits))).alias("slot"))
        .groupBy("slot")
        .agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") >= least)
        .select(F.expr("shiftright(slot, 6)").alias("word"), F.expr("shiftleft(1L, cast(slot & 63 as int))").alias("bits"))
    )
    blank = spark.range(0, bits >> 6, 1, 4).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("bits"))
    words = hit.union(blank).groupBy("word").agg(F.expr("bit_or(bits)").alias("bits"))
    return words.agg(F.sort_array(F.collect_list(F.struct("word", "bits"))).getField("bits").alias("words"))


def may_repeat(key: str, bitmap: DataFrame, bits: int) -> Column:
    """True if all slots of the key are in the bitmap, which every task gets once."""
    words = bitmap.scalar()
    both = F.lit(True)
    for slot in _slots(key, bits):
        word = F.element_at(words, (F.shiftright(slot, 6) + 1).cast("int"))
        both = both & (F.getbit(word, slot.bitwiseAND(F.lit(63)).cast("int")) == 1)
    return both


def _keepers(candidates: DataFrame) -> DataFrame:
    """Per digest the row that stays: most code points, then smallest id."""
    best = F.min(F.struct((-F.col("n_points")).alias("p"), F.col("id").isNull().alias("none"), F.col("id").alias("id")))
    return (
        candidates.groupBy("sha")
        .agg(best.alias("best"), F.count(F.lit(1)).alias("group_size"))
        .select("sha", F.col("best.id").alias("keep_id"), (-F.col("best.p")).alias("keep_points"), "group_size")
    )


def _digests(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    return settle(
        docs.select(
            F.col(id_column).alias("id"),
            F.length(text_of(text_column)).alias("n_points"),
            digest(text_of(text_column)).alias("sha"),
        )
    )


def duplicate_groups(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """A row per document: id, keep_id, group_size, kept, sha (of the normalised text)."""
    rows = _digests(docs, id_column, text_column)
    bits = bits_for(rows.count())
    possible = may_repeat("sha", repeated_bitmap(rows, "sha", bits), bits)
    candidates = rows.filter(possible)
    keepers = settle(_keepers(candidates))  # as a table of its own, so that the join can split or broadcast it
    shared = candidates.join(keepers, "sha").select(
        "id",
        "keep_id",
        "group_size",
        (F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("n_points") == F.col("keep_points"))).alias("kept"),
        "sha",
    )
    alone = rows.filter(~possible).select(
        "id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "sha"
    )
    return alone.unionByName(shared)


def drop_exact_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The documents that stay, with all their columns. Only texts that may repeat are shuffled."""
    rows = _digests(docs, id_column, text_column)
    bits = bits_for(rows.count())
    bitmap = repeated_bitmap(rows, "sha", bits)
    keepers = settle(_keepers(rows.filter(may_repeat("sha", bitmap, bits))))
    whole = packed_rows(docs).select(
        ROW,
        F.col(f"{ROW}.{id_column}").alias("id"),
        digest(text_of(f"{ROW}.{text_column}")).alias("sha"),
        F.length(text_of(f"{ROW}.{text_column}")).alias("n_points"),
    )
    possible = may_repeat("sha", bitmap, bits)
    stay = (
        whole.filter(possible)
        .join(keepers, "sha")
        .filter(F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("n_points") == F.col("keep_points")))
        .dropDuplicates(["sha"])
    )
    return unpacked_rows(whole.filter(~possible).select(ROW).unionByName(stay.select(ROW)))
