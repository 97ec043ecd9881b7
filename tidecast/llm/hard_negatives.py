"""Hard negatives by segment summary filtering.

Of each vector's segments the mean and the deviation are kept. Over a segment of n components the inner product of
two vectors is n * mean * mean' plus or minus at most n * deviation * deviation' (Cauchy and Schwarz), so the
summed summaries bound a score from above and below. Segments are refined from ``LENGTHS[0]`` components down to
``LENGTHS[-1]``: a pair whose bounds lie outside every window an anchor still looks into, or under the k-th best
score that is known for it, is discarded at the first level that shows it. A level that discards less than it costs
rests, and is tried again every ``REST`` steps. What is left is scored exactly, in whole numbers.

Scale: rows are dealt by hash into groups of at most about ``HELD`` components, anchors into ``PARTS`` parts at most,
and a task works on one group and one part. It holds its rows in chunks of about ``ROWS``, as the smallest whole numbers
that fit, while its anchors stream past in blocks of about ``ANCHORS``; of a block it puts out the k best of each window
and forgets it. So what a task holds does not grow with the table, and what is shuffled is each row ``PARTS`` times at
most and each anchor once a group. The tasks' findings are ranked with a limit applied before the shuffle. Nothing goes
through the driver but a few figures. The label or vector of a third of all rows makes no difference, since rows are
dealt by key; blocks and chunks without a common label are not compared for positives. Every anchor meets every row, so
the time grows with the square of the table.

Defined cases: rows with a null id, label, vector or a null or non-finite component take no part; shorter vectors
count as filled up with zeros; rows that repeat an id are rows of their own, also as anchors; ties go to the
smaller id; an anchor without positives, or a positive without negatives, gives no row; an empty table an empty
result. Scores must fit in a long.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidecast.llm.common import settle

POSITIVES = 5
NEGATIVES = 3
LOW, HIGH = 50, 95  # of 100 parts of the positive's score
LENGTHS = (16, 4, 2)
ROWS, ANCHORS = 4096, 512
HELD = 1 << 24  # components of the rows that a task holds
GROUPS, PARTS = 8, 2  # groups of rows at least, if there are as many chunks; parts of the anchors at most
PAIRS = 1 << 28  # pairs that make a task worth its while; groups and parts only grow for more
REST = 256
_STEP, _KNOWN = 1024, 256  # rows compared at once; rows seen from which on the best of them may discard others
_EACH, _APART = 1 << 16, 16  # pairs scored one by one at once; times the cost of a pair that is scored with many
_EXACT = 2.0**53
_FAR = 2**62


class Summaries:
    """Scaled means and deviations of vectors, a pair of matrices per segment length, made when first asked for."""

    def __init__(self, vectors: np.ndarray):
        self.vectors = vectors
        self.made: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def level(self, level: int) -> tuple[np.ndarray, np.ndarray]:
        if level not in self.made:
            cut = self.vectors.astype(np.float64).reshape(len(self.vectors), -1, LENGTHS[level])
            mean = cut.mean(axis=2)
            self.made[level] = mean * np.sqrt(LENGTHS[level]), np.sqrt(np.square(cut - mean[:, :, None]).sum(axis=2))
        return self.made[level]

    def bounds(self, level: int, own: np.ndarray, other: Summaries, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest possible scores of the vectors ``own`` and those of ``other`` at ``rows``."""
        (mean, spread), (means, spreads) = self.level(level), other.level(level)
        middle, margin = mean[own] @ means[rows].T, spread[own] @ spreads[rows].T
        slack = 0.5 + 1e-9 * (np.abs(middle) + margin)  # scores are whole numbers; rounding stays far below
        return middle - margin - slack, middle + margin + slack


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise exact inner products of whole numbers."""
    if len(a) and a.shape[1] * np.abs(a).max(initial=0).astype(np.float64) * np.abs(b).max(initial=0) >= _EXACT:
        return np.array([sum(x * y for x, y in zip(p, q)) for p, q in zip(a.tolist(), b.tolist())], dtype=np.int64)
    return np.einsum("ij,ij->i", a.astype(np.float64), b.astype(np.float64)).astype(np.int64)


def _wide(vectors: np.ndarray, width: int) -> np.ndarray:
    """Filled up with zeros."""
    return vectors if vectors.shape[1] == width else np.pad(vectors, ((0, 0), (0, width - vectors.shape[1])))


class Levels:
    """Which levels of the summaries pay; the costs of a level and of a score are multiplications and passes over the pairs."""

    def __init__(self):
        self.rests = [0] * len(LENGTHS)

    def due(self, level: int) -> bool:
        self.rests[level] = max(0, self.rests[level] - 1)
        return not self.rests[level]

    def discarded(self, level: int, width: int, share: float) -> None:
        if share * (width + 16) < 2 * width / LENGTHS[level] + 48:
            self.rests[level] = REST


class Block:
    """Anchors, and the ``keep`` best rows found so far in each of their windows.

    ``anchors`` has arrays label, key and vectors, and low and high (anchor x window); chunks of rows label, key, id and vectors.
    """

    def __init__(self, anchors: dict, same_label: bool, keep: int, levels: Levels):
        self.label, self.key, self.vectors = anchors["label"], anchors["key"], anchors["vectors"]
        self.low, self.high, self.same_label, self.levels = anchors["low"], anchors["high"], same_label, levels
        n, windows = self.low.shape
        self.least = np.where(self.low <= self.high, self.low, _FAR)  # the score that a row needs, per anchor and window
        self.most = np.where(self.low <= self.high, self.high, -_FAR).max(axis=1)
        self.n_found = np.zeros((windows, n), dtype=np.int64)
        self.score, self.id, self.row = (np.zeros((windows, n, keep), dtype=np.int64) for _ in range(3))
        self.seen = 0

    def meet(self, rows: dict) -> None:
        """Looks for better rows in a chunk."""
        who, seen = np.arange(len(self.key)), self.seen
        mixed = len({self.label.min(), self.label.max(), rows["label"].min(), rows["label"].max()}) > 1
        if self.same_label and mixed:
            who = np.flatnonzero((self.label >= rows["label"].min()) & (self.label <= rows["label"].max()))
            near = (rows["label"] >= self.label.min()) & (rows["label"] <= self.label.max())
            rows = {k: v[near] for k, v in rows.items()}
            seen = 0 if (self.n_found[:, who] == 0).any() else seen
        if not len(who) or not len(rows["key"]) or not self.same_label and not mixed:
            return
        width = max(self.vectors.shape[1], rows["vectors"].shape[1])
        own, others = _wide(self.vectors, width), _wide(rows["vectors"], width)
        a, b = (x.astype(np.float64) for x in (own, others))
        reach = 1.0001 * np.sqrt(np.square(a).sum(axis=1).max()) * np.sqrt(np.square(b).sum(axis=1).max())
        if reach < 2**24:  # no sum of some of the products is larger, so all are exact
            a, b = a.astype(np.float32), b.astype(np.float32)
        slack = 0 if reach < _EXACT else (width + 16) * 2.0**-52 * (reach + _FAR)
        summaries, begin, better = (Summaries(own), Summaries(others)), 0, []
        while begin < len(others):
            end = min(len(others), begin + min(_STEP, max(32, seen)))  # few at first, while nearly every row is among the best
            better.append(self._better(rows, who, np.arange(begin, end), (own, others), (a, b), slack, summaries if seen >= _KNOWN else None, mixed))
            seen, begin = seen + end - begin, end
            if begin == len(others) or seen <= _STEP or sum(len(x[0]) for x in better) >= _STEP:
                anchor, row, score = (np.concatenate(x) for x in zip(*better))
                better = []
                for w in range(self.low.shape[1]):
                    ok = (score >= self.least[anchor, w]) & (score <= self.high[anchor, w])
                    if ok.any():
                        self._add(w, anchor[ok], score[ok], rows["id"][row[ok]], rows["key"][row[ok]])
        self.seen += len(others)

    def _better(self, rows: dict, who: np.ndarray, part: np.ndarray, whole: tuple, floats: tuple, slack: float, summaries: tuple | None, mixed: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(anchor, row, score) of the pairs that may count, among some anchors and some rows of a chunk."""
        alive, width, work = None, floats[0].shape[1], len(who) * len(part)
        least, most = self.least.min(axis=1) - slack, self.most + slack
        for level in range(len(LENGTHS) if summaries else 0):
            if not self.levels.due(level):
                continue
            under, over = summaries[0].bounds(level, who, summaries[1], part)
            fits = (over >= least[who, None]) & (under <= most[who, None])
            fits = fits if alive is None else fits & alive
            a, r = fits.any(axis=1), fits.any(axis=0)
            left = min(np.count_nonzero(a) * np.count_nonzero(r), _APART * np.count_nonzero(fits))
            self.levels.discarded(level, width, 1 - left / work)
            who, part, alive, work = who[a], part[r], fits[np.ix_(a, r)], left
            if not work:
                return who[:0], part[:0], np.zeros(0, dtype=np.int64)
        if work < len(who) * len(part):  # few pairs here and there
            x, y = np.nonzero(alive)
            a, r = who[x], part[y]
            score = np.concatenate([np.einsum("ij,ij->i", floats[0][a[k : k + _EACH]], floats[1][r[k : k + _EACH]]) for k in range(0, len(a), _EACH)])
            ok = score >= least.astype(score.dtype)[a]
            a, r, score = a[ok], r[ok], score[ok]
        else:
            scores = floats[0][who] @ floats[1][part].T
            fits = scores >= least.astype(scores.dtype)[who, None]
            if alive is not None:
                fits &= alive
            if self.same_label and mixed:
                fits &= self.label[who, None] == rows["label"][None, part]
            if np.count_nonzero(fits) > fits.size >> 6:
                fits &= scores <= most.astype(scores.dtype)[who, None]
            at = np.flatnonzero(fits)
            a, r, score = who[at // len(part)], part[at % len(part)], scores.ravel()[at]
        ok = ((self.label[a] == rows["label"][r]) == self.same_label) & (self.key[a] != rows["key"][r])
        a, r, score = a[ok], r[ok], score[ok].astype(np.int64)
        if slack:
            score = np.concatenate([score[:0], *(products(whole[0][a[k : k + _EACH]], whole[1][r[k : k + _EACH]]) for k in range(0, len(a), _EACH))])
        return a, r, score

    def _add(self, w: int, who: np.ndarray, score: np.ndarray, ids: np.ndarray, keys: np.ndarray) -> None:
        keep, old = self.score.shape[2], np.unique(who)
        known = np.arange(keep)[None, :] < self.n_found[w, old][:, None]
        who = np.concatenate([np.repeat(old, self.n_found[w, old]), who])
        score, ids, keys = (np.concatenate([x[w, old][known], y]) for x, y in ((self.score, score), (self.id, ids), (self.row, keys)))
        order = np.lexsort((keys, ids, -score, who))
        first = np.flatnonzero(np.concatenate([[True], np.diff(who[order]) != 0]))
        rank = np.arange(len(order)) - np.repeat(first, np.diff([*first, len(order)]))
        order, rank = order[rank < keep], rank[rank < keep]
        who = who[order]
        for x, y in ((self.score, score), (self.id, ids), (self.row, keys)):
            x[w, who, rank] = y[order]
        self.n_found[w, old] = np.bincount(who, minlength=len(self.key))[old]
        full = old[self.n_found[w, old] == keep]
        self.least[full, w] = self.score[w, full, keep - 1]

    def found(self) -> pa.RecordBatch:
        w, who, rank = np.nonzero(np.arange(self.score.shape[2])[None, None, :] < self.n_found[:, :, None])
        columns = self.key[who], w.astype(np.int32), *(x[w, who, rank] for x in (self.score, self.id, self.row))
        return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["anchor_key", "window", "score", "id", "key"])


def usable(vectors: DataFrame, id_column: str = "vec_id", vector: str = "embedding", label: Column | None = None) -> DataFrame:
    """(key, id, label, v) of the rows that take part; v holds floor(256 * x) of each component, key is unique."""
    whole = F.transform(F.col(vector), lambda x: F.floor(F.lit(256.0) * x.cast("double")))
    odd = F.exists(F.col(vector), lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == F.lit(float("inf"))))
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), (F.col("label") if label is None else label).cast("long").alias("label"), whole.alias("v"), odd.alias("odd"))
    good = rows.filter("id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL AND NOT odd")
    return good.select(F.monotonically_increasing_id().alias("key"), "id", "label", "v")


def _matrix(column: pa.Array) -> np.ndarray:
    """The lists as rows of the smallest whole numbers that fit, filled up with zeros to whole segments."""
    flat, ends = column.flatten().to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    sizes = np.diff(ends)
    most = max(int(flat.max(initial=0)), -int(flat.min(initial=0)))
    kind = next((t for t in (np.int16, np.int32) if most <= np.iinfo(t).max), np.int64)
    out = np.zeros((len(sizes), -(-max(int(sizes.max(initial=0)), 1) // LENGTHS[0]) * LENGTHS[0]), dtype=kind)
    out[np.arange(out.shape[1])[None, :] < sizes[:, None]] = flat
    return out


def _part(batch: pa.RecordBatch, windows: int) -> dict:
    """Arrays of the rows, with the windows of anchors; windows that an anchor hasn't got hold nothing."""
    part = {name: batch.column(name).to_numpy() for name in ("key", "id", "label")} | {"vectors": _matrix(batch.column("v"))}
    if batch.column("low").null_count:
        return part
    for name, nothing in (("low", _FAR), ("high", -_FAR)):
        sizes = np.diff(batch.column(name).offsets.to_numpy())
        part[name] = np.full((len(sizes), windows), nothing)
        part[name][np.arange(windows)[None, :] < sizes[:, None]] = batch.column(name).flatten().to_numpy(zero_copy_only=False)
    return part


def _joined(parts: list[dict]) -> dict:
    width = max(p["vectors"].shape[1] for p in parts)
    return {k: np.concatenate([_wide(p[k], width) if k == "vectors" else p[k] for p in parts]) for k in parts[0]}


FOUND = "anchor_key long, window int, score long, id long, key long"


def _runs(batches, chunk_rows: int, block_anchors: int, windows: int):
    """(cell, whether anchors, arrays) of batches sorted by cell and then the rows before the anchors, in pieces of the given sizes."""
    held, at = [], None
    for batch in batches:
        cell, anchor = batch.column("cell").to_numpy(), batch.column("anchor").to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero((np.diff(cell) != 0) | (anchor[1:] != anchor[:-1])) + 1), batch.num_rows]
        for begin, end in zip(cuts, cuts[1:]):
            if begin == end:
                continue
            if at != (cell[begin], anchor[begin]):
                if held:
                    yield *at, _joined(held)
                held, at = [], (cell[begin], anchor[begin])
            size = block_anchors if anchor[begin] else chunk_rows
            while begin < end:
                n = min(end - begin, size - sum(len(p["key"]) for p in held))
                held.append(_part(batch.slice(begin, n), windows))
                begin += n
                if sum(len(p["key"]) for p in held) == size:
                    yield *at, _joined(held)
                    held = []
    if held:
        yield *at, _joined(held)


def _cells(same_label: bool, keep: int, windows: int, chunk_rows: int, block_anchors: int):
    """Over rows sorted by cell, in which rows come before anchors, the best rows of every anchor's windows."""

    def work(batches):
        at, chunks, levels = None, [], Levels()
        for cell, anchors, part in _runs(batches, chunk_rows, block_anchors, windows):
            if cell != at:
                at, chunks = cell, []
            if not anchors:
                chunks.append(part)
                continue
            block = Block(part, same_label, keep, levels)
            for chunk in chunks:
                block.meet(chunk)
            yield block.found()

    return work


def _searched(rows: DataFrame, anchors: DataFrame, groups: int, parts: int, same_label: bool, keep: int, windows: int, chunk_rows: int, block_anchors: int) -> DataFrame:
    """The ``keep`` best rows of each anchor and window, ranked from 1."""
    dealt = lambda name, n: F.pmod(F.xxhash64("key", F.lit(name)), F.lit(n)).cast("int").alias(name)
    every = lambda name, n: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    none = F.lit(None).cast("array<long>")
    held = rows.select(dealt("group", groups), every("part", parts), F.lit(False).alias("anchor"), "key", "id", "label", "v", none.alias("low"), none.alias("high"))
    sent = anchors.select(every("group", groups), dealt("part", parts), F.lit(True).alias("anchor"), "key", "id", "label", "v", "low", "high")
    cells = held.unionByName(sent).select((F.col("group") * parts + F.col("part")).alias("cell"), "anchor", "key", "id", "label", "v", "low", "high")
    order = ["cell", "anchor", "label"] if same_label else ["cell", "anchor"]
    found = cells.repartitionById(groups * parts, "cell").sortWithinPartitions(*order).mapInArrow(_cells(same_label, keep, windows, chunk_rows, block_anchors), FOUND)
    best = Window.partitionBy("anchor_key", "window").orderBy(F.col("score").desc(), "id", "key")
    return settle(found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= keep))


def dealing(n: int, n_anchors: int, width: int, chunk_rows: int) -> tuple[int, int]:
    """Groups of the rows and parts of the anchors: so many that a task's rows fit; more for much work, while the anchors sent stay half the rows."""
    pairs = n * n_anchors
    fit, worth = -(-n // max(chunk_rows, HELD // max(1, width))), min(-(-pairs // PAIRS), n // (2 * max(1, n_anchors)))
    groups = max(1, fit, worth, min(GROUPS, -(-n // chunk_rows)))
    return groups, min(PARTS, max(1, pairs // (4 * PAIRS * groups)))


def mine(rows: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, chunk_rows: int = ROWS, block_anchors: int = ANCHORS) -> DataFrame:
    """Hard negatives of the anchors among ``rows`` (key, id, label, v).

    A positive is one of the ``positives`` best rows of the anchor's label; its negatives are the ``negatives`` best rows
    of other labels with low * positive <= 100 * score <= high * positive.
    """
    rows = settle(rows)
    anchors = settle(rows.filter(is_anchor))
    n, width, largest, smallest = rows.agg(F.count("*"), F.max(F.size("v")), F.max(F.array_max("v")), F.min(F.array_min("v"))).first()
    n_anchors = anchors.count()
    groups, parts = dealing(n, n_anchors, width or 1, chunk_rows)
    kind = next((t for t, bits in (("smallint", 15), ("int", 31)) if -(2**bits) <= (smallest or 0) and (largest or 0) < 2**bits), "long")
    rows, anchors = (x.withColumn("v", F.col("v").cast(f"array<{kind}>")) for x in (rows, anchors))
    everything = anchors.select("*", F.array(F.lit(-_FAR)).alias("low"), F.array(F.lit(_FAR)).alias("high"))
    best = _searched(rows, everything, groups, parts, True, positives, 1, chunk_rows, block_anchors)
    least = F.expr(f"cast(ceil(cast({low} * cast(score AS decimal(25)) AS decimal(28)) / 100) AS long)")
    most = F.expr(f"cast(floor(cast({high} * cast(score AS decimal(25)) AS decimal(28)) / 100) AS long)")
    windows = best.groupBy("anchor_key").agg(F.sort_array(F.collect_list(F.struct("rank", least.alias("low"), most.alias("high")))).alias("w"))
    looking = anchors.join(windows.withColumnRenamed("anchor_key", "key"), "key").select("key", "id", "label", "v", F.col("w.low").alias("low"), F.col("w.high").alias("high"))
    held = _searched(rows, looking, groups, parts, False, negatives, positives, chunk_rows, block_anchors)
    of = best.select("anchor_key", (F.col("rank") - 1).alias("window"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    names = anchors.select(F.col("key").alias("anchor_key"), F.col("id").alias("anchor_id"))
    return (
        held.select("anchor_key", "window", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
        .join(of, ["anchor_key", "window"])
        .join(names, "anchor_key")
        .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    )
