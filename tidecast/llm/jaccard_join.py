"""Similarity join of shingle sets by signatures of their parts.

Two sets link when 100 * |intersection| >= ``PERCENT`` * |union|. Equal sets are one node. Linked sets of n and m shingles
differ in at most d = (n + m) * (100 - ``PERCENT``) / (100 + ``PERCENT``) of them. So shingles are dealt by hash into parts, a
little more than d of them, and a key tells all that a set has in one part: of the first d + 1 parts in which a set has any,
linked sets agree in one. As a part holds some five shingles, sets that have little else in common seldom meet.

* Sizes fall into classes of which a partner is in the same or the next one. A set puts out keys for the class of pairs whose
  smaller set is in its own class, and for the class below, each with as many parts as that class may need.
* A set with too few parts that aren't empty is dealt again by another hash, and at last by single shingles; two sets that
  miss each other for empty parts both do so. Sets of up to ``cut`` shingles may be keyed by single shingles from the start.
* Under a key of up to ``list_size`` sets all are compared. What meets under crowded keys shares a passage or is a
  family of near copies. Such sets are keyed anew from those of their shingles that another of them holds, the frequent ones
  in parts that come last; the number of unshared ones is a difference with any partner, so it takes as many fewer keys,
  and a set with more of them than a link admits has no partner.

Sets are compared in rounds and only if they aren't joined yet: under each key the first set, then the next 7, then all up
to the 64th ... are compared with all that follow. First come those with the fewest unshared shingles that meet most others. Where
they meet, the parities of ``64 * WORDS`` hashed groups of shingles and the unshared ones give a lower bound of the difference that
discards most pairs; each one left is verified once by its exact intersection. A family of n near copies so gives about n
pairs and not their square; rounds end when no key has sets of two components that weren't compared.

Scale: a set puts out keys for about a third of its shingles. Only texts of sets with a key in common are read
again; they are known by a Bloom filter of their marks. Joins have a row per set or per pair left, never one per key.
Copies collapse to a node by aggregation with map-side combination. A task that compares holds the sets of one key.

Defined cases: null text counts as empty; fewer words than a shingle make one shingle; texts without words have an
empty set and link with nothing, not with each other; rows that repeat an id are rows of their own; a null id counts
last for the smallest id; an empty table gives an empty result. Shingles and sets are told apart by 64-bit hashes.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidecast.llm.common import settle, text_of
from tidecast.llm.components import connected_components
from tidecast.llm.exact_dedup import bits_for, may_repeat, repeated_bitmap

SHINGLE = 4
PERCENT = 85
SEED = 13
LIST = 32
_BUFFER = 1 << 20
WORDS = 8  # longs of parities a set
MORE = 8  # times as many sets of a key are compared in each round
_MOST = 4096  # but no more at once
_BROADCAST = 100_000  # pairs
_TASK_ROWS = 1 << 17  # no more tasks than it takes to give each so many rows
_JUDGED = 4096  # pairs a task
_DEALS = 3  # hashes by which shingles are dealt into parts

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def shingle_set(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The sorted distinct hashes of a whole text's shingles."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "replace").translate(_LOWER).split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    whole = b" ".join(words)
    if len(words) <= shingle:
        return np.array([xxh64_intdigest(whole, SEED)], dtype=np.uint64)
    ends = list(accumulate(len(w) + 1 for w in words))
    return np.unique(np.fromiter((xxh64_intdigest(whole[a : e - 1], SEED) for a, e in zip([0, *ends], ends[shingle - 1 :])), dtype=np.uint64))


def _node(hashes: np.ndarray) -> int:
    from xxhash import xxh64_intdigest

    return int(np.uint64(xxh64_intdigest(hashes.tobytes())).view(np.int64))


class _Seen:
    """The nodes a task has met lately, so that most copies of a text cost it nothing more."""

    LIMIT = 1 << 17

    def __init__(self):
        self.nodes: set[int] = set()

    def add(self, node: int) -> bool:
        """Whether the node is new; it is remembered."""
        if node in self.nodes:
            return False
        if len(self.nodes) == self.LIMIT:
            self.nodes = set()
        self.nodes.add(node)
        return True


def least_shared(n: int, percent: int) -> int:
    """What a set of n has to share with a partner."""
    return -(-n * percent // 100)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def size_classes(largest: int, percent: int) -> np.ndarray:
    """The least sizes of the classes up to that of ``largest``, and the one after."""
    least = [2]
    while least[-1] <= largest:
        least.append(least[-1] * 100 // percent + 1)
    return np.array(least, dtype=np.int64)


def part_keys(sets: list[np.ndarray], sizes: np.ndarray, percent: int, cut: int = 0, unshared: np.ndarray | None = None, late: list[np.ndarray] | None = None) -> list[np.ndarray]:
    """The keys of every set; linked sets have one in common.

    ``sets`` holds sorted hashes, all of a set or all but the ``unshared`` ones that no other set holds; ``late`` tells which
    of them go to the last parts.
    """
    less = np.zeros(len(sets), dtype=np.int64) if unshared is None else unshared
    least = size_classes(int(sizes.max()), percent)
    own = np.searchsorted(least, sizes, "right") - 1
    found = [(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64))]
    for below in (0, 1):  # pairs whose smaller set is in the class of the set, or in the one below
        of = own - below
        top = least[np.maximum(of, 0) + 1] - 1
        differ = (sizes + (top if below else sizes * 100 // percent)) * (100 - percent) // (100 + percent)
        parts = ((top + top * 100 // percent) * (100 - percent) // (100 + percent) + 1) * 11 // 10 + 2
        need = differ - less + 1
        left = np.flatnonzero((of >= 0) & (differ > 0) & (need > 0))
        for deal in range(_DEALS + 1):
            if deal < _DEALS and cut:
                now, left = left[top[left] > cut], left[top[left] <= cut]
            else:
                now, left = left, left[:0]
            if len(now):
                short = _keys_of(found, now, [sets[k] for k in now], None if late is None else [late[k] for k in now], parts[now], need[now], of[now], deal + (0 if unshared is None else _DEALS + 1), deal == _DEALS)
                left = np.sort(np.concatenate([left, now[short]]))
    who, keys = (np.concatenate(c) for c in zip(*found))
    order = np.argsort(who, kind="stable")
    return np.split(keys[order].view(np.int64), np.cumsum(np.bincount(who, minlength=len(sets)))[:-1])


def _keys_of(found, who, sets, late, parts, need, of, deal, single) -> np.ndarray:
    """Add (set, key) of the first ``need`` parts that aren't empty to ``found``; whether a set has too few of them."""
    sizes = np.array([len(s) for s in sets])
    hashes, doc = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    last = np.zeros(len(hashes), dtype=bool) if late is None else np.concatenate(late)
    if single:
        order = np.lexsort((hashes, last, doc))
        hashes, parts = hashes[order], sizes
        part = np.arange(len(hashes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    mixed = _mixed(hashes + np.uint64(1 + 1000 * deal))
    if not single:
        part = (mixed >> np.uint64(32)).astype(np.int64) % parts[doc] + np.where(last, parts[doc], 0)
        parts = parts if late is None else 2 * parts
    begins = np.cumsum(parts) - parts
    total = int(parts.sum())
    slot = begins[doc] + part
    held = np.zeros(total, dtype=np.uint64)
    np.add.at(held, slot, mixed)
    full = np.zeros(total + 1, dtype=np.int64)
    full[1 + slot] = 1
    ranks, of_slot = np.cumsum(full), np.repeat(np.arange(len(sets)), parts)
    kept = np.flatnonzero(full[1:] & (ranks[1:] - ranks[begins][of_slot] <= need[of_slot]))
    place = np.zeros(len(kept), dtype=np.int64) if single else kept - begins[of_slot[kept]]
    mark = (of[of_slot[kept]] * (2 * _DEALS + 2) + deal) << 32 | place
    found.append((who[of_slot[kept]], _mixed(held[kept] ^ _mixed(mark.astype(np.uint64)))))
    return ranks[begins + parts] - ranks[begins] < need


SCAN = "id long, mark long, node long, n int, keys binary"


def _scan(percent: int, shingle: int, cut: int):
    """Over (id, mark, text): a row per document; ``keys`` of the sets that the task hasn't met before."""

    def work(batches):
        seen = _Seen()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                sets = [shingle_set(t, shingle) for t in part.column(2).to_pylist()]
                nodes = [_node(s) for s in sets]
                keys: list[bytes | None] = [None] * len(sets)
                new = [k for k, (x, s) in enumerate(zip(nodes, sets)) if seen.add(x) and len(s) > 1]
                if new:
                    for k, own in zip(new, part_keys([sets[k] for k in new], np.array([len(sets[k]) for k in new]), percent, cut)):
                        keys[k] = own.tobytes() if len(own) else None
                columns = [part.column(0), part.column(1), pa.array(nodes, pa.int64()), pa.array([len(s) for s in sets], pa.int32()), pa.array(keys, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["id", "mark", "node", "n", "keys"])

    return work


POSTED = "shingle long, node long, frequency int"


def _post(batches):
    """Over (node, longs as binary): (shingle, node, frequency) of each, which may be a key or a shingle; its list has to tell the frequency."""
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            part = batch.slice(at, 1024)
            own = [np.frombuffer(b, dtype=np.int64) for b in part.column(1).to_pylist()]
            items = np.concatenate(own)
            nodes = np.repeat(part.column(0).to_numpy(), [len(x) for x in own])
            yield pa.RecordBatch.from_arrays([pa.array(items), pa.array(nodes), pa.array(np.zeros(len(items), dtype=np.int32))], ["shingle", "node", "frequency"])


def _lists(rows: DataFrame) -> DataFrame:
    """(node, shingle, frequency) of what two nodes or more hold, from (node, longs as binary)."""
    return rows.mapInArrow(_post, POSTED).repartition("shingle").sortWithinPartitions("shingle", "node").mapInArrow(_shared, "node long, shingle long, frequency int")


def _shared(batches):
    """Over postings sorted by (shingle, node): (node, shingle, frequency) of all shingles of two nodes or more."""

    def out(shingle, nodes, frequency):
        return pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(shingle), pa.array(frequency.astype(np.int32))], ["node", "shingle", "frequency"])

    tail, passing, last = None, None, 0  # the list read so far; or the shingle of a long one that goes out as it comes
    for batch in batches:
        shingle, node, frequency = (batch.column(k).to_numpy() for k in range(3))
        known = frequency > 0
        if known.any():
            yield out(shingle[known], node[known], frequency[known])
            shingle, node = shingle[~known], node[~known]
        if passing is not None:
            n = int((shingle == passing).sum())
            mine = np.unique(node[:n])
            mine = mine[mine != last]
            if len(mine):
                yield out(np.full(len(mine), passing), mine, np.full(len(mine), _BUFFER))
                last = mine[-1]
            shingle, node = shingle[n:], node[n:]
            passing = None if len(shingle) else passing
        if tail is not None:
            shingle, node = np.concatenate([tail[0], shingle]), np.concatenate([tail[1], node])
        if not len(shingle):
            continue
        new = np.concatenate([[True], (shingle[1:] != shingle[:-1]) | (node[1:] != node[:-1])])
        shingle, node = shingle[new], node[new]
        starts = np.flatnonzero(np.concatenate([[True], shingle[1:] != shingle[:-1]]))
        cut = starts[-1]
        yield from _whole_lists(shingle[:cut], node[:cut], starts[:-1], out)
        tail = shingle[cut:], node[cut:]
        if len(tail[0]) > _BUFFER:  # its exact number doesn't matter, as long as all its entries carry the same one
            yield out(*tail, np.full(len(tail[0]), _BUFFER))
            passing, last, tail = tail[0][0], tail[1][-1], None
    if tail is not None:
        yield from _whole_lists(*tail, np.zeros(1, dtype=np.int64), out)


def _whole_lists(shingle, node, starts, out):
    sizes = np.diff(np.append(starts, len(shingle)))
    frequency = np.repeat(sizes, sizes)
    keep = frequency > 1
    if keep.any():
        yield out(shingle[keep], node[keep], frequency[keep])


def parities(shingles: list[int]) -> list[int]:
    """Bit b tells whether the number of shingles that are b modulo the bits is odd; sets differ in no fewer shingles than bits."""
    return np.frombuffer(_parities(np.array(shingles, dtype=np.int64)), dtype=np.int64).tolist()


def _parities(shingles: np.ndarray) -> bytes:
    odd = np.bincount(shingles.view(np.int64) & (64 * WORDS - 1), minlength=64 * WORDS) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


CONTENT = "node long, n int, parities binary, hashes binary"


def _read_again(shingle: int):
    """Over (text): the content of the sets that the task hasn't met before."""

    def work(batches):
        seen = _Seen()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                sets = [(x, s) for t in batch.column(0).slice(at, 512).to_pylist() if len(s := shingle_set(t, shingle)) > 1 and seen.add(x := _node(s))]
                columns = [[x for x, _ in sets], [len(s) for _, s in sets], [_parities(s) for _, s in sets], [s.tobytes() for _, s in sets]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.binary(), pa.binary()))], ["node", "n", "parities", "hashes"])

    return work


CROWDED = "node long, n int, unshared int, parities binary, keys binary"


def _keyed_anew(percent: int, cut: int, list_size: int):
    """Over (node, frequency, shingle) sorted by node, the size of a node first as frequency -1: the sets that may have partners."""

    def records(node, frequency, shingle):
        starts = np.flatnonzero(frequency == -1)
        for at in range(0, len(starts), 512):
            edges = np.append(starts, len(node))[at : at + 513].tolist()
            spans = [(a, z) for a, z in zip(edges, edges[1:]) if z - a > 1 and z - a - 1 >= least_shared(int(shingle[a]), percent)]
            if not spans:
                continue
            n = np.array([shingle[a] for a, _ in spans])
            sets = [shingle[a + 1 : z].view(np.uint64) for a, z in spans]
            unshared = n - [len(s) for s in sets]
            keys = part_keys(sets, n, percent, cut, unshared, [frequency[a + 1 : z] > list_size for a, z in spans])
            columns = [node[[a for a, _ in spans]], n, unshared, [_parities(s) for s in sets], [k.tobytes() for k in keys]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()))], ["node", "n", "unshared", "parities", "keys"])

    def work(batches):
        tail = None
        for batch in batches:
            rows = [c.to_numpy() for c in batch.columns]
            if tail is not None:
                rows = [np.concatenate(c) for c in zip(tail, rows)]
            if not len(rows[0]):
                continue
            cut_at = int(np.searchsorted(rows[0], rows[0][-1], "left"))
            yield from records(*(c[:cut_at] for c in rows))
            tail = [c[cut_at:] for c in rows]
        if tail is not None:
            yield from records(*tail)

    return work


def _gathered(lists: DataFrame, list_size: int | None = None) -> DataFrame:
    """(node, keys, weight, most) of (node, shingle, frequency); without the keys of over ``list_size`` sets."""
    kept = F.lit(True) if list_size is None else F.col("frequency") <= list_size
    return lists.groupBy("node").agg(F.collect_list(F.when(kept, F.col("shingle"))).alias("keys"), F.sum(F.when(kept, F.col("frequency").cast("long"))).alias("weight"), F.max("frequency").alias("most"))


RECORDS = ["node", "n", "unshared", "parities", "weight", "keys"]


def records(texts: DataFrame, scanned: DataFrame, percent: int = PERCENT, shingle: int = SHINGLE, cut: int = 0, list_size: int = LIST) -> tuple[DataFrame, DataFrame]:
    """The content of the sets that have a key in common with another, and their ``RECORDS``: a row per set and way of keying it."""
    met = settle(_gathered(_lists(scanned.filter("keys IS NOT NULL").select("node", "keys")), list_size))
    marks = scanned.filter("n > 1").groupBy("node").agg(F.min("mark").alias("mark"))
    marks = settle(marks.join(met.select("node"), "node").select("mark").distinct())
    bits = bits_for(marks.count())
    again = texts.filter(may_repeat("mark", repeated_bitmap(marks, "mark", bits, least=1), bits)).select("text")
    content = again.mapInArrow(_read_again(shingle), CONTENT).join(met.select("node"), "node", "left_semi").dropDuplicates(["node"])
    content = settle(content)
    plain = content.select("node", "n", "parities").join(met.filter(F.size("keys") > 0), "node").withColumn("unshared", F.lit(0))
    crowded = content.join(met.filter(F.col("most") > list_size).select("node"), "node").select("node", "n", "hashes")
    crowded = crowded.repartition(F.xxhash64("node"))  # evenly, whatever way they were joined
    sizes = crowded.select("node", F.col("n").cast("long").alias("shingle"), F.lit(-1).alias("frequency"))
    listed = _lists(crowded.select("node", "hashes")).unionByName(sizes).select("node", "frequency", "shingle")
    sorted_ = listed.repartition("node").sortWithinPartitions("node", F.col("frequency") > 0, "shingle")
    anew = settle(sorted_.mapInArrow(_keyed_anew(percent, cut, list_size), CROWDED))
    shared = _gathered(_lists(anew.select("node", "keys")))
    return content.select("node", "n", "hashes"), settle(plain.select(RECORDS).unionByName(anew.drop("keys").join(shared, "node").select(RECORDS)))


def _meet(done: int, upto: int, percent: int):
    """Over (key, unshared, n, parities, root, node) sorted by key: the pairs (a, b) whose sets may link and aren't joined.

    Under each key the sets from number ``done`` to ``upto`` are compared with all that follow; ``most`` is set if others remain.
    """
    names = ["a", "b", "most"]

    def pairs(key, unshared, n, root, node, bits):
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        sizes = np.diff(np.append(starts, len(key)))
        mixed = np.minimum.reduceat(root, starts) < np.maximum.reduceat(root, starts)
        later = starts[mixed & (sizes > upto)] + upto
        # the next to be compared has the fewest unshared ones of those left
        if (unshared[later] * (100 + percent) <= np.maximum.reduceat(n, starts)[mixed & (sizes > upto)] * (100 - percent)).any():
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([int(sizes.max())], pa.int32())], names)
        begin, place = np.repeat(starts, sizes), np.arange(len(key)) - np.repeat(starts, sizes)
        rows = np.flatnonzero(np.repeat(mixed, sizes))
        for centre in range(done, upto):
            rows = rows[place[rows] > centre]
            if not len(rows):
                break
            for at in range(0, len(rows), _BUFFER):
                mine = rows[at : at + _BUFFER]
                first = begin[mine] + centre
                apart, most = unshared[mine] + unshared[first], (n[mine] + n[first]) * (100 - percent)
                open_ = (root[mine] != root[first]) & (apart * (100 + percent) <= most)
                mine, first, apart, most = mine[open_], first[open_], apart[open_], most[open_]
                apart = apart + np.bitwise_count(bits[mine] ^ bits[first]).sum(axis=1, dtype=np.int64)
                near = apart * (100 + percent) <= most
                a, b = node[mine[near]], node[first[near]]
                if len(a):
                    both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
                    yield pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1]), pa.nulls(both.shape[1], pa.int32())], names)

    def work(batches):
        tail = None
        for batch in batches:
            key, unshared, n, root, node = (batch.column(k).to_numpy().astype(np.int64) for k in (0, 1, 2, 4, 5))
            bits = np.frombuffer(b"".join(batch.column(3).to_pylist()), dtype=np.uint64).reshape(-1, WORDS)
            rows = [key, unshared, n, root, node, bits]
            if tail is not None:
                rows = [np.concatenate(c) for c in zip(tail, rows)]
            if not len(rows[0]):
                continue
            cut_at = int(np.searchsorted(rows[0], rows[0][-1], "left"))
            if cut_at:
                yield from pairs(*(c[:cut_at] for c in rows))
            tail = [c[cut_at:] for c in rows]
        if tail is not None:
            yield from pairs(*tail)

    return work


def _judge(percent: int):
    """Over (a, b, hashes of a, hashes of b): whether they link, by the exact intersection."""

    def work(batches):
        for batch in batches:
            links = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                common = len(np.intersect1d(np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64), assume_unique=True))
                links.append(common * 100 >= ((len(x) + len(y)) // 8 - common) * percent)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(links, pa.bool_())], ["a", "b", "links"])

    return work


def links(content: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(node, root) of the nodes that have a link."""
    roots, linked, tested, done, upto = None, None, None, 0, 1
    tasks = (sets.agg(F.sum(F.size("keys"))).first()[0] or 0) // _TASK_ROWS + 1
    while True:
        labelled = sets.withColumn("root", F.col("node"))
        if roots is not None:
            labelled = sets.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        filed = labelled.select(F.explode("keys").alias("key"), "unshared", "n", "parities", "root", "node", (-F.col("weight")).alias("rank"))
        ordered = filed.repartition("key").coalesce(tasks).sortWithinPartitions("key", "unshared", "rank", "node").drop("rank")
        met = settle(ordered.mapInArrow(_meet(done, upto, percent), "a long, b long, most int"))
        pairs = met.filter("a IS NOT NULL").select("a", "b").distinct()
        pairs = pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti")
        pairs = settle(pairs.coalesce(met.count() // _TASK_ROWS + 1))
        number = pairs.count()
        if number:
            sent = F.broadcast(pairs) if number <= _BROADCAST else pairs
            sides = [content.join(sent, F.col("node") == F.col(side)).select("a", "b", F.col("hashes").alias(f"{side}s")) for side in ("a", "b")]
            judged = settle(sides[0].join(sides[1], ["a", "b"]).coalesce(number // _JUDGED + 1).mapInArrow(_judge(percent), "a long, b long, links boolean"))
            tested = judged.select("a", "b") if tested is None else tested.unionByName(judged.select("a", "b"))
            found = judged.filter("links").select("a", "b")
            if not found.isEmpty():
                linked = found if linked is None else linked.unionByName(found)
                roots = connected_components(linked, size=linked.count()).select("node", "root")
        if met.filter("most IS NOT NULL").isEmpty():
            break
        done, upto = upto, min(upto * MORE, upto + _MOST)
    return sets.select("node", F.col("node").alias("root")).limit(0) if roots is None else roots


def jaccard_groups(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", percent: int = PERCENT, shingle: int = SHINGLE, cut: int | None = None, list_size: int = LIST) -> DataFrame:
    """A row per document: id, n_shingles, component (the smallest id that links reach)."""
    text = F.col(text_column)
    texts = docs.select(F.col(id_column).cast("long").alias("id"), F.xxhash64(text_of(text_column)).alias("mark"), text.alias("text"))
    scanned = settle(texts.mapInArrow(_scan(percent, shingle, cut or 0), SCAN))
    rows = scanned.select("id", "node", "n")
    least = rows.filter("n > 0").groupBy("node").agg(F.min("id").alias("least"))
    roots = links(*records(texts, scanned, percent, shingle, cut or 0, list_size), percent)
    joined = settle(least.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
    groups = joined.groupBy("root").agg(F.min("least").alias("component"))
    of = settle(joined.join(groups, "root").select("node", "component"))
    full = rows.filter("n > 0").join(of, "node").select("id", F.col("n").cast("long").alias("n_shingles"), "component")
    empty = rows.filter("n = 0").select("id", F.lit(0).cast("long").alias("n_shingles"), F.col("id").alias("component"))
    return full.unionByName(empty)
