"""Repeated passages across documents, by deep-shallow sorting of sparse suffixes.

Every byte covered by a string of ``LENGTH`` bytes that also starts somewhere else is found and removed.

*Sparse suffixes.* Each window of ``LENGTH`` bytes has an anchor: the position in it whose ``GRAM``-byte
gram hashes least, the leftmost of equals. The anchor depends on the window's bytes only, so equal
windows have it at the same place. An anchor stands for a run of windows and comes with their bytes, its
context. About one position in 185 is an anchor, and only anchors whose gram occurs twice go on.

*Equal contexts* are counted by hash: a context seen twice is repeated as a whole, and one copy of it is
compared with the other contexts of its gram.

*Sorting.* The suffixes from the anchors of a gram are put in order by deep-shallow sorting: multikey
quicksort on 8-byte words down to ``SHALLOW`` bytes, then a blind trie for each group that still agrees.
Neighbours are then joined in order of falling common prefix; when two sets join at prefix r, each
suffix learns the longest common left context l with the other set (from its neighbours in the order of left contexts);
where l + r reaches ``LENGTH``, the bytes from l before the anchor to r after it are repeated.

Scale: texts are joined by document with what concerns them (twice), never grouped. A gram with more
than ``HOT`` different contexts isn't sorted in one task: its windows are counted by hash instead, which
deals them to all tasks and gives the same bytes.

Defined cases: null text counts as empty; documents under ``LENGTH`` bytes lose nothing; overlaps and repeats
in the same document count; rows repeated with id and text are repeats of each other; null ids are
kept; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidecast.llm.common import settle, text_of

LENGTH = 400
GRAM = 32
SHALLOW = 96
HOT = 4096
_SEGMENT = 1 << 22
_PLACE = np.uint64((1 << 24) - 1)
_FACTOR = 0x9E3779B97F4A7C15
_INVERSE = pow(_FACTOR, -1, 1 << 64)
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS["up"]) < n:
        size = max(n, 1 << 16)
        for name, factor in (("up", _FACTOR), ("down", _INVERSE)):
            p = np.full(size, factor, dtype=np.uint64)
            p[0] = 1
            _POWERS[name] = np.multiply.accumulate(p)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def _gram_hashes(raw: np.ndarray) -> np.ndarray:
    up, down = _powers(len(raw))
    total = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(raw.astype(np.uint64) * up + up, out=total[1:])
    h = (total[GRAM:] - total[:-GRAM]) * down[: len(raw) - GRAM + 1]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def _window_minima(v: np.ndarray, width: int) -> np.ndarray:
    """Least value in each window, from running minima of blocks."""
    n = len(v)
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[:n] = v
    padded = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(padded, axis=1).reshape(-1)
    back = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def anchors(raw: np.ndarray, length: int = LENGTH):
    """(places, first windows, last windows, gram hashes) of a document's anchors."""
    out = []
    for at in range(0, max(0, len(raw) - length + 1), _SEGMENT):
        part = raw[at : at + _SEGMENT + length - 1]
        h = _gram_hashes(part)
        least = _window_minima((h & ~_PLACE) | np.arange(len(h), dtype=np.uint64), length - GRAM + 1)
        place = (least & _PLACE).astype(np.int64)
        first = np.flatnonzero(np.diff(place, prepend=-1))
        last = np.append(first[1:], len(place)) - 1
        out.append((place[first] + at, first + at, last + at, h[place[first]].view(np.int64)))
    return [np.concatenate(x) for x in zip(*out)] if out else [np.zeros(0, dtype=np.int64)] * 4


# --- sorting -----------------------------------------------------------------------------------


def common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    apart = int.from_bytes(a[:n], "little") ^ int.from_bytes(b[:n], "little")
    return ((apart & -apart).bit_length() - 1) >> 3


def _branch(s: bytes, depth: int) -> int:
    return s[depth] if depth < len(s) else -1


class BlindTrie:
    """Inner nodes are [depth, {byte: child}], leaves lists of numbers of equal strings; -1 is the end of a string."""

    def __init__(self, strings: list[bytes]):
        self.strings, self.root = strings, None

    def insert(self, number: int) -> None:
        s = self.strings[number]
        if self.root is None:
            self.root = ("leaf", [number])
            return
        node = self.root
        while node[0] != "leaf":  # blind: only branching bytes are looked at
            kids = node[1]
            node = kids.get(_branch(s, node[0])) or next(iter(kids.values()))
        other = self.strings[node[1][0]]
        depth = common(s, other)
        if depth == len(s) == len(other):
            node[1].append(number)
            return
        up, node = None, self.root
        while node[0] != "leaf" and node[0] < depth:
            up, node = node, node[1][_branch(s, node[0])]
        leaf = ("leaf", [number])
        if node[0] == depth:
            node[1][_branch(s, depth)] = leaf
            return
        split = [depth, {_branch(s, depth): leaf, _branch(other, depth): node}]
        if up is None:
            self.root = split
        else:
            up[1][_branch(s, up[0])] = split

    def in_order(self) -> list[int]:
        out, stack = [], [self.root] if self.root else []
        while stack:
            node = stack.pop()
            if node[0] == "leaf":
                out += node[1]
            else:
                stack += [node[1][k] for k in sorted(node[1], reverse=True)]
        return out


def deep_shallow_order(strings: list[bytes], shallow: int = SHALLOW) -> list[int]:
    """Numbers of the strings in order."""
    out: list[int] = []
    stack = [(list(range(len(strings))), 0)]
    while stack:
        group, depth = stack.pop()
        if len(group) < 2:
            out += group
        elif depth >= shallow:
            trie = BlindTrie(strings)
            for k in group:
                trie.insert(k)
            out += trie.in_order()
        else:
            words = [strings[k][depth : depth + 8] for k in group]
            pivot = sorted((words[0], words[len(words) // 2], words[-1]))[1]
            less = [k for k, w in zip(group, words) if w < pivot]
            same = [k for k, w in zip(group, words) if w == pivot]
            more = [k for k, w in zip(group, words) if w > pivot]
            stack += [(more, depth), (same, depth + 8 if len(pivot) == 8 else shallow), (less, depth)]
    return out


def repeated_ranges(lefts: list[bytes], rights: list[bytes], length: int = LENGTH) -> list[list[tuple[int, int]]]:
    """Per context the (bytes before, bytes after) its anchor that it shares with another one, where both make ``length``.

    ``lefts`` are the bytes before the anchor, backwards; ``rights`` those from the anchor on.
    """
    n = len(rights)
    found: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    best = [-1] * n
    order = deep_shallow_order(rights)
    shared = [common(rights[a], rights[b]) for a, b in zip(order, order[1:])]
    by_left = deep_shallow_order(lefts)
    rank = [0] * n
    for k, x in enumerate(by_left):
        rank[x] = k
    set_of, sets = list(range(n)), [[rank[x]] for x in range(n)]

    def top(x: int) -> int:
        while set_of[x] != x:
            set_of[x] = set_of[set_of[x]]
            x = set_of[x]
        return x

    def learn(x: int, left: int, right: int) -> None:
        if left > best[x] and left + right >= length:
            best[x] = left
            found[x].append((left, right))

    for k in sorted(range(n - 1), key=lambda k: -shared[k]):
        big, small, right = top(order[k]), top(order[k + 1]), shared[k]
        if len(sets[big]) < len(sets[small]):
            big, small = small, big
        into = sets[big]
        for r in sets[small]:
            x, at = by_left[r], bisect_left(into, r)
            for other in (by_left[p] for p in into[max(at - 1, 0) : at + 1]):
                left = common(lefts[x], lefts[other])
                learn(x, left, right)
                learn(other, left, right)
            insort(into, r)
        set_of[small], sets[small] = big, []
    return found


# --- Spark -------------------------------------------------------------------------------------

_ANCHORS = "doc_id long, h long, place long, first long, last long, gram long, context binary"
_CONTEXTS = "gram long, context binary, before int, bytes binary"
_RANGES = "context binary, a int, b int"


def _batch(schema: str, columns) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields)], [n for n, _ in fields])


def _find_anchors(length: int):
    def work(batches):
        from xxhash import xxh3_128_digest

        for batch in batches:
            for doc_id, h, text in zip(*(batch.column(k).to_pylist() for k in range(3))):
                raw = text.encode("utf-8")
                place, first, last, gram = anchors(np.frombuffer(raw, dtype=np.uint8), length)
                if not len(place):
                    continue
                spans = zip(place.tolist(), first.tolist(), last.tolist())
                context = [xxh3_128_digest(raw[a : z + length] + b"%d,%d" % (p - a, z - a)) for p, a, z in spans]
                n = len(place)
                yield _batch(_ANCHORS, ([doc_id] * n, [h] * n, place, first, last, gram, context))

    return work


def _cut_contexts(length: int):
    def work(batches):
        for batch in batches:
            for text, wanted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                raw = text.encode("utf-8")
                rows = [(w["gram"], w["context"], w["place"] - w["first"], raw[w["first"] : w["last"] + length]) for w in wanted]
                yield _batch(_CONTEXTS, zip(*rows))

    return work


def _sort_grams(length: int):
    """Ranges from contexts sorted by gram."""

    def solve(rows):
        lefts = [data[:before][::-1] for _, before, data in rows]
        rights = [data[before:] for _, before, data in rows]
        found = repeated_ranges(lefts, rights, length)
        return [(rows[k][0], -left, right) for k, pairs in enumerate(found) for left, right in pairs]

    def work(batches):
        gram, rows, out = None, [], []
        for batch in batches:
            for g, *row in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if g != gram and rows:
                    out += solve(rows)
                    rows = []
                gram = g
                rows.append(row)
            if out:
                yield _batch(_RANGES, zip(*out))
                out = []
        if rows and (out := solve(rows)):
            yield _batch(_RANGES, zip(*out))

    return work


def _windows(length: int):
    def work(batches):
        from xxhash import xxh3_128_digest

        for batch in batches:
            for context, before, data in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3))):
                n = len(data) - length + 1
                yield _batch("context binary, a int, window binary", ([context] * n, range(-before, n - before), [xxh3_128_digest(data[k : k + length]) for k in range(n)]))

    return work


def _remove(length: int):
    def work(batches):
        for batch in batches:
            rows = []
            for doc_id, text, ranges in zip(*(batch.column(k).to_pylist() for k in range(3))):
                raw, spans = text.encode("utf-8"), []
                for r in sorted((r["a"], r["b"]) for r in ranges or ()):
                    if spans and r[0] <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], r[1])
                    else:
                        spans.append(list(r))
                edges = [0, *(x for s in spans for x in s), len(raw)]
                kept = b"".join(raw[a:z] for a, z in zip(edges[::2], edges[1::2]))
                rows.append((doc_id, len(raw), len(raw) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), kept))
            yield _batch(_RESULT, zip(*rows))

    return work


_RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_bytes binary"


def repeated_spans(docs: DataFrame, length: int = LENGTH, hot: int = HOT) -> DataFrame:
    """(doc_id, h, ranges) of the documents with repeated bytes; ``docs`` has doc_id, h (hash of the text) and text."""
    found = settle(docs.select("doc_id", "h", "text").mapInArrow(_find_anchors(length), _ANCHORS))
    # Stored, so that the join below has plain exchanges on both sides and a gram with many anchors is split over tasks.
    twice = settle(found.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("gram"))
    shared = settle(found.join(twice, "gram"))
    where = F.struct("doc_id", "h", "place", "first", "last")
    distinct = settle(shared.groupBy("gram", "context").agg(F.count(F.lit(1)).alias("n"), F.min(where).alias("at")))
    many = settle(distinct.groupBy("gram").agg(F.count(F.lit(1)).alias("contexts")).filter("contexts > 1"))
    compared = distinct.join(many, "gram").select("gram", "context", "contexts", "at.*")
    wanted = compared.groupBy("doc_id", "h").agg(F.collect_list(F.struct("gram", "context", "place", "first", "last")).alias("wanted"))
    texts = docs.select(F.col("doc_id").alias("d"), F.col("h").alias("e"), "text")
    cut = texts.join(wanted, F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("e") == F.col("h"))).select("text", "wanted")
    contexts = settle(cut.mapInArrow(_cut_contexts(length), _CONTEXTS)).join(many, "gram")
    usual = contexts.filter(F.col("contexts") <= hot).drop("contexts").dropDuplicates(["gram", "context"])
    ranges = usual.repartition("gram").sortWithinPartitions("gram", "context").mapInArrow(_sort_grams(length), _RANGES)
    crowded = contexts.filter(F.col("contexts") > hot).drop("contexts").dropDuplicates(["gram", "context"])
    windows = crowded.mapInArrow(_windows(length), "context binary, a int, window binary")
    again = windows.groupBy("window").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("window")
    ranges = ranges.unionByName(windows.join(again, "window").select("context", "a", (F.col("a") + length).alias("b")))
    ranges = settle(ranges.dropDuplicates())
    part = shared.join(ranges, "context").select("doc_id", "h", (F.col("place") + F.col("a")).alias("a"), (F.col("place") + F.col("b")).alias("b"))
    whole = distinct.filter("n > 1").select("context")
    full = shared.join(whole, "context").select("doc_id", "h", F.col("first").alias("a"), (F.col("last") + length).alias("b"))
    return part.unionByName(full).groupBy("doc_id", "h").agg(F.collect_list(F.struct("a", "b")).alias("ranges"))


def remove_repeats(docs: DataFrame, length: int = LENGTH, hot: int = HOT, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """A row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and the bytes that are left."""
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), text_of(text_column).alias("text"))
    rows = rows.withColumn("h", F.xxhash64("text"))
    spans = settle(repeated_spans(rows, length, hot)).select(F.col("doc_id").alias("d"), F.col("h").alias("e"), "ranges")
    joined = rows.join(spans, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("e")), "left").select("doc_id", "text", "ranges")
    return joined.mapInArrow(_remove(length), _RESULT)
