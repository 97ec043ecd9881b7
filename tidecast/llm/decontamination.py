"""Benchmark decontamination by CGK embedding, bit-sampling LSH and exact edit verification.

A document is contaminated by an item when a passage of it is within edit distance ``(1 - SIMILARITY)``
times the item's length of the whole item; both are lower-cased with runs of white space as one space.

The CGK embedding reads a string by a random walk: at step t it puts out the byte under the pointer and
moves on if a random bit of (t, byte) says so. Strings at small edit distance meet again after an edit,
so they agree in most steps: edit distance becomes Hamming distance. Walks of ``STEPS`` steps start at
every byte of an item (its item-sized window at offset 0, and those its later parts begin) and at every
``STRIDE``-th byte of a document. A bit sample is ``SAMPLED`` steps of a walk, and windows that agree in
a whole sample hit. A leaked item of n bytes holds about n / ``STRIDE`` document starts, each tried under
``WALKS`` times ``SAMPLES`` samples; wherever a start hits (``HITS`` = 1), the item is verified at that place by
exact edit distance to the best passage of the document's window (bit-parallel). ``expected_recall`` gives the
recall of these repeats for a rate of edits, counting edits against each start alone. Starts whose samples already differ
from every item's after some of the steps are given up there, which loses no hit.

Items under ``MEDIUM`` bytes hold too few starts for that and are sought without loss: of one more pieces of an
item than edits allowed, a passage within that distance holds one unedited; where a piece occurs the item is verified.

Scale: documents are read once and never shuffled. Items are sent in blocks of at most about
``BLOCK_BYTES`` of text, each a pass over the documents, so what a task holds has a fixed bound.

Defined cases: null or empty documents and items match nothing; items too short for a walk
(``SHORT`` bytes) match only where they occur exactly, as whole words; repeated ids of documents give a row each;
repeated item ids are all compared and the closest counts; empty tables give an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidecast.llm.common import packed_rows, place_of, settle, text_of, texts_of, unpacked_rows

SIMILARITY = 0.8
STEPS = 40
STRIDE = 2
WALKS = 2
SAMPLES = 2
SAMPLED = 20
HITS = 1
SHORT = 24
MEDIUM = 64
BLOCK_BYTES = 1 << 18
_SLICE = 1 << 16
_STOPS = {18: 18, 26: 20, STEPS: 21}  # steps after which starts go whose samples so far occur in no item, and the bits of the filter there


def expected_recall(item_bytes: int, edit_rate: float) -> float:
    """The chance of ``HITS`` hits, counting only starts whose (STEPS + 1) / 2 bytes hold no edit.

    Starts are taken as independent; walks that meet again after an edit add to this.
    """
    span = (STEPS + 1) / 2
    starts = max(1, int((item_bytes - span) / STRIDE))
    p = (1 - edit_rate) ** span
    return 1 - sum(math.comb(starts, k) * p**k * (1 - p) ** (starts - k) for k in range(HITS))


def normalised(text: str | None) -> bytes:
    return " ".join((text or "").lower().split()).encode("utf-8", "replace")


class _Walks:
    """The random choices: where each walk moves on, and what each sample hashes."""

    def __init__(self, seed: int = 2017):
        rng = np.random.default_rng(seed)
        moves = rng.integers(0, 2, (WALKS, STEPS, 256), dtype=np.int32).astype(np.intp)
        samples = [[rng.choice(STEPS, SAMPLED, replace=False) for _ in range(SAMPLES)] for _ in range(WALKS)]
        codes = rng.integers(0, 1 << 64, (WALKS, SAMPLES, STEPS, 256), dtype=np.uint64)
        for w, r in np.ndindex(WALKS, SAMPLES):
            codes[w, r, ~np.isin(np.arange(STEPS), samples[w][r])] = 0
        # Two steps at once: the byte under the pointer and the next one tell both.
        first, second = np.divmod(np.arange(1 << 16), 256)
        self.moves, self.codes = {}, {}
        for w, t in np.ndindex(WALKS, STEPS // 2):
            then = np.where(moves[w, 2 * t][first], second, first)
            self.moves[w, t] = moves[w, 2 * t][first] + moves[w, 2 * t + 1][then]
            for r in range(SAMPLES):
                code = codes[w, r, 2 * t][first] ^ codes[w, r, 2 * t + 1][then]
                if code.any():
                    self.codes[w, t, r] = code

    def keys(self, w: int, raw: np.ndarray, starts: np.ndarray, stop):
        """(starts, keys by sample) at the end of walk ``w``; ``raw`` has STEPS bytes past the last start, as index numbers.

        ``stop(steps, keys)`` is called after each of ``_STOPS`` with the keys of the samples so far and says which starts go on.
        """
        pairs = raw[:-1] * 256 + raw[1:]
        at, key = starts.astype(np.intp), np.zeros((SAMPLES, len(starts)), dtype=np.uint64)
        for t in range(STEPS // 2):
            pair = pairs.take(at)
            for r in range(SAMPLES):
                if (w, t, r) in self.codes:
                    key[r] ^= self.codes[w, t, r].take(pair)
            at += self.moves[w, t].take(pair)
            if 2 * t + 2 in _STOPS:
                on = stop(2 * t + 2, key)
                starts, at, key = starts[on], at[on], key[:, on]
        return starts, key


def _shift(steps: int) -> np.uint64:
    return np.uint64(64 - _STOPS[steps])


class Index:
    """The keys of a block of items."""

    def __init__(self, items: list[tuple[int, str]], similarity: float):
        self.walks, self.items, self.short, self.medium = _Walks(), [], [], []
        self.seen = np.zeros((WALKS, STEPS + 1, SAMPLES), dtype=object)
        for place in np.ndindex(self.seen.shape):
            self.seen[place] = np.zeros(1 << _STOPS[place[1]], dtype=bool) if place[1] in _STOPS else None
        keys, where = [], []
        for item_id, text in items:
            raw = normalised(text)
            if not raw:
                continue
            own = raw.decode("utf-8")
            if len(raw) < SHORT:
                self.short.append((item_id, own))
                continue
            bits: dict[str, int] = {}
            for k, c in enumerate(own):
                bits[c] = bits.get(c, 0) | 1 << k
            if len(raw) < MEDIUM:
                self.medium.append((item_id, own, bits, math.floor((1 - similarity) * len(own) + 1e-9)))
                continue
            number = len(self.items)
            self.items.append((item_id, own, bits, math.floor((1 - similarity) * len(own) + 1e-9), len(raw)))
            starts = np.arange(0, len(raw) - SHORT // 2)
            padded = np.frombuffer(raw + bytes(STEPS + 1), dtype=np.uint8).astype(np.intp)
            for w in range(WALKS):
                for key in self.walks.keys(w, padded, starts, lambda steps, key: self._mark(w, steps, key))[1]:
                    keys.append(key)
                    where.append(np.stack([np.full(len(starts), number), starts], axis=1))
        self.keys = np.concatenate(keys) if keys else np.zeros(0, dtype=np.uint64)
        order = np.argsort(self.keys, kind="stable")
        self.keys = self.keys[order]
        self.where = np.concatenate(where)[order] if where else np.zeros((0, 2), dtype=np.int64)

    def _mark(self, w: int, steps: int, key: np.ndarray):
        for r in range(SAMPLES):
            self.seen[w, steps, r][key[r] >> _shift(steps)] = True
        return slice(None)

    def _marked(self, w: int, steps: int, key: np.ndarray):
        """The starts with a sample that agrees so far with some item's, and maybe others: none that agrees in the end is lost."""
        on = self.seen[w, steps, 0].take((key[0] >> _shift(steps)).view(np.int64))
        for r in range(1, SAMPLES):
            on |= self.seen[w, steps, r].take((key[r] >> _shift(steps)).view(np.int64))
        return np.flatnonzero(on)

    def candidates(self, raw: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Rows (start, item, offset in the item) whose keys agree."""
        out = []
        if not len(self.keys):
            starts = starts[:0]
        for a in range(0, len(starts), _SLICE):
            piece = starts[a : a + _SLICE]
            near = raw[piece[0] : piece[-1] + STEPS + 1].astype(np.intp)
            for w in range(WALKS):
                part, keys = self.walks.keys(w, near, piece - piece[0], lambda steps, key: self._marked(w, steps, key))
                part = part + piece[0]
                for r, key in enumerate(keys):
                    own = np.flatnonzero(self.seen[w, STEPS, r][key >> _shift(STEPS)])
                    key = key[own]
                    lo = np.searchsorted(self.keys, key, "left")
                    n = np.searchsorted(self.keys, key, "right") - lo
                    hit = np.flatnonzero(n)
                    if len(hit):
                        n, lo = n[hit], lo[hit]
                        each = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                        out.append(np.column_stack([np.repeat(part[own[hit]], n), self.where[each]]))
        return np.concatenate(out) if out else np.zeros((0, 3), dtype=np.int64)


def best_distance(item: str, bits: dict[str, int], window: str, most: int) -> int:
    """Least edit distance of the item to any passage of the window, bit-parallel; over ``most`` counts as most + 1."""
    if item in window:
        return 0
    n = len(item)
    every, top = (1 << n) - 1, 1 << (n - 1)
    plus, minus, score, best, get = every, 0, n, n, bits.get
    for a in range(0, len(window), 32):
        for c in window[a : a + 32]:
            equal = get(c, 0)
            xh = (((equal & plus) + plus) ^ plus) | equal
            up = minus | ~(xh | plus) & every
            down = plus & xh
            if up & top:
                score += 1
            elif down & top:
                score -= 1
                if score < best:
                    best = score
            up <<= 1
            equal |= minus
            plus = (down << 1 | ~(equal | up)) & every
            minus = up & equal & every
        if best > most and score - (len(window) - a - 32) > most:
            break
    return min(best, most + 1)


def piecewise_distance(item: str, bits: dict[str, int], text: str, most: int) -> int:
    """As best_distance over a whole text: of ``most`` + 1 pieces of the item, a passage that near holds one unedited."""
    n, windows = len(item), []
    edges = [round(n * k / (most + 1)) for k in range(most + 2)]
    for a, z in zip(edges, edges[1:]):
        at = text.find(item[a:z])
        while at >= 0:
            windows.append((max(0, at - a - most), at - a + n + most))
            at = text.find(item[a:z], at + 1)
    best, begin, end = most + 1, 0, -1
    for x, y in [*sorted(windows), (len(text) + n, 0)]:  # overlapping windows are one
        if x > end:
            if end > 0:
                best = min(best, best_distance(item, bits, text[begin:end], most))
            begin, end = x, y
        end = max(end, y)
    return best


def _supported(number: np.ndarray, item: np.ndarray, place: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Rows (text, item, first of 32 places) under which ``HITS`` starts of a text or more agree with an item."""
    hits = np.unique(np.column_stack([number, item, place >> 5, start]), axis=0)
    rows, n = np.unique(hits[:, :3], axis=0, return_counts=True)
    return rows[n >= HITS] * [1, 1, 32]


def _windows(rows: np.ndarray, items: list[tuple]):
    """(text, item, begin, end) of the windows to compare; ``rows`` are sorted.

    Windows that share as many bytes as any passage within the allowance may have are one: each such passage lies in one of the two.
    """
    last = None
    for k, j, step in rows.tolist():
        most, size = items[j][3:]
        slack = 4 * most + 16  # a character has up to four bytes
        begin, end = step - slack, step + 32 + size + slack  # 32 places begin here
        if last and last[:2] == (k, j) and last[3] - begin >= size + 4 * most:
            last = (k, j, last[2], end)
            continue
        if last:
            yield last
        last = (k, j, begin, end)
    if last:
        yield last


def matches(index: Index, texts: list[str | None]) -> list[tuple[int, int, int, int]]:
    """(number of the text, item id, edit distance, length of the item) of every contaminated text and item."""
    raws = [normalised(t) for t in texts]
    gap = bytes(STEPS + 1)
    begins = np.cumsum([0, *(len(r) + len(gap) for r in raws)])
    raw = np.frombuffer(gap.join(raws) + gap, dtype=np.uint8)
    starts = np.concatenate([np.arange(b, b + len(r), STRIDE) for b, r in zip(begins, raws)] or [np.zeros(0, dtype=np.int64)])
    found = index.candidates(raw, starts)
    best: dict[tuple[int, int], tuple[int, int]] = {}
    if len(found):
        number = np.searchsorted(begins, found[:, 0], "right") - 1
        place = found[:, 0] - begins[number] - found[:, 2]
        rows = np.unique(np.concatenate([_supported(number, found[:, 1], place + shift, found[:, 0]) - [0, 0, shift] for shift in (0, 16)]), axis=0)
        for k, j, begin, end in _windows(rows, index.items):
            item_id, own, bits, most, _ = index.items[j]
            at = (k, item_id)
            if at in best and best[at][0] == 0:
                continue
            d = best_distance(own, bits, raws[k][max(0, begin) : max(0, end)].decode("utf-8", "ignore"), most)
            if d <= most and (at not in best or d < best[at][0]):
                best[at] = (d, len(own))
    for item_id, own in index.short:
        for k, r in enumerate(raws):
            if f" {own} ".encode() in b" " + r + b" ":
                best.setdefault((k, item_id), (0, len(own)))
    if index.medium:
        for k, r in enumerate(raws):
            text = r.decode("utf-8")
            for item_id, own, bits, most in index.medium:
                d = piecewise_distance(own, bits, text, most)
                if d <= most and d < best.get((k, item_id), (most + 1, 0))[0]:
                    best[k, item_id] = (d, len(own))
    return [(k, i, d, n) for (k, i), (d, n) in sorted(best.items())]


SCHEMA = "doc_id long, item_id long, distance int, item_length int"


def _find(docs: DataFrame, items: list[tuple[int, str]], similarity: float) -> DataFrame:
    """The matches of (doc_id, text, sha); sha is passed on."""
    sent = docs.sparkSession.sparkContext.broadcast(items)

    def work(batches):
        index = Index(sent.value, similarity)
        for batch in batches:
            ids, shas = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            for a in range(0, len(ids), 256):
                found = matches(index, batch.column(1).slice(a, 256).to_pylist())
                if found:
                    k, item, d, n = zip(*found)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([ids[a + x] for x in k], pa.int64()), pa.array(item, pa.int64()), pa.array(d, pa.int32()), pa.array(n, pa.int32()), pa.array([shas[a + x] for x in k], pa.string())],
                        ["doc_id", "item_id", "distance", "item_length", "sha"],
                    )

    return docs.mapInArrow(work, SCHEMA + ", sha string")


def _items(benchmark: DataFrame, item_id: str, item_text: str) -> DataFrame:
    return benchmark.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).alias("text")).filter("text IS NOT NULL")


def _blocks(items: DataFrame) -> list[list[tuple[int, str]]]:
    """The items in blocks of about half of ``BLOCK_BYTES``; the texts of an item id share a block."""
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    blocks = max(1, -(-2 * size // BLOCK_BYTES))
    dealt = items.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(blocks)))
    return [[(r.item_id, r.text) for r in dealt.filter(F.col("block") == block).collect()] for block in range(blocks)]


def _contaminations(docs: DataFrame, items: DataFrame, similarity: float) -> DataFrame:
    """The matches of (doc_id, text, sha) over all blocks of items."""
    out = None
    for rows in _blocks(items):  # a block is bounded, and so is each pass's broadcast
        found = _find(docs, rows, similarity)
        out = found if out is None else out.unionByName(found)
    return out


def contaminations(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, id_column: str = "doc_id", text_column: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, distance, item_length) of every document and item where the document holds the item."""
    texts = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"), F.lit(None).cast("string").alias("sha"))
    return _contaminations(texts, _items(benchmark, item_id, item_text), similarity).drop("sha")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, id_column: str = "doc_id", text_column: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The documents, with all their columns, that hold no item: each row passes or goes by itself, none is shuffled."""
    whole = packed_rows(docs)
    schema = whole.schema
    for rows in _blocks(_items(benchmark, item_id, item_text)):  # what one block's pass lets through, the next one reads
        whole = whole.mapInArrow(_clean_rows(docs, rows, similarity, text_column), schema)
    return unpacked_rows(whole)


def _clean_rows(docs: DataFrame, items: list[tuple[int, str]], similarity: float, text_column: str):
    sent, place = docs.sparkSession.sparkContext.broadcast(items), place_of(docs, text_column)

    def work(batches):
        index = Index(sent.value, similarity)
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                gone = {k for k, *_ in matches(index, texts_of(part.column(0), place))}
                yield part.filter(pa.array([k not in gone for k in range(part.num_rows)]))

    return work
