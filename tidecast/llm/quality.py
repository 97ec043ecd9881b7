"""Quality scores from preference pairs: a Bradley-Terry model over text features.

Labelled documents give preference pairs: a document with label 1 is preferred to one with label 0.
The chance that a beats b is the logistic function of w (f(a) - f(b)), so w is learned by logistic loss
on feature differences, with Spark's logistic regression. Every pairing round matches each document of the larger class
with one drawn from the other; pairs are never listed in full. The ranking score w f is then placed on a
threshold by score quantile: of a grid of quantiles of the training scores, the one that separates the two labels
best; a logistic curve through it maps that quantile to ``CUT`` and all scores into 0 to 1.

Features are read from the whole text (see ``features``) and scaled by mean and deviation of the
training rows. Training takes every labelled row that it may use. Equal rows of features count as one with a weight. Each
round deals the rows by hash into groups of about ``GROUP_ROWS``, pairs them there, and goes on until ``PAIRS`` rows were dealt,
in 2 to ``ROUNDS`` rounds; a scarce class is copied to as many groups as it takes to have one to draw from. Quantiles are read from counts in
``BINS`` bins of the training scores, so what reaches the driver has a fixed bound.

Defined cases: null text counts as empty; empty texts have a score as any other; without both labels
every score is 0.5; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidecast.llm.common import extended, packed_rows, place_of, settle, texts_of, unpacked_rows

ROUNDS = 60
PAIRS = 400_000
GROUP_ROWS = 8192
SCARCE = 16
PENALTY = 1e-3
QUANTILES = 2000
BINS = 1 << 15
CUT = 0.3

FEATURES = (
    "log_length",
    "symbol_share",
    "bar_share",
    "upper_share",
    "mark_share",
    "repeated_words",
    "same_next_word",
    "same_next_sentence",
    "repeated_lines",
    "top_word_share",
    "word_length",
    "stop_share",
    "symbol_words",
)
_SYMBOLS = b"#$%&*^~<>{}[]\\"
_MARKS = b"!?"
_DELETE = {name: bytes(set(range(256)) - set(kept)) for name, kept in {"symbols": _SYMBOLS, "bar": b"|", "marks": _MARKS}.items()}
_UPPER = re.compile(r"(?<=[^\W\d_])[A-Z\xc0-\xd6\xd8-\xde]")  # inside a word
_SYMBOL_WORD = re.compile(r"[#$%&*|]")


def features(text: str) -> list[float]:
    """Shares of symbols, repetitions and the like, all bounded, over the whole text."""
    raw = text.encode("utf-8", "replace")
    n = len(raw)
    if not n:
        return [0.0] * len(FEATURES)
    count = {name: len(raw.translate(None, gone)) for name, gone in _DELETE.items()}
    words = text.split()
    w = max(len(words), 1)
    tally: dict[str, int] = {}
    for x in words:
        tally[x] = tally.get(x, 0) + 1
    sentences = text.replace("\n", ".").split(".")
    sentences = [s.strip() for s in sentences if len(s) > 1]
    lines = [x for x in text.split("\n") if x]
    same = sum(map(str.__eq__, words, words[1:]))
    return [
        math.log1p(n) / 10,
        math.sqrt(count["symbols"] / n),
        math.sqrt(count["bar"] / n),
        math.sqrt(len(_UPPER.findall(text)) / n),
        math.sqrt(count["marks"] / n),
        1 - len(tally) / w,
        math.sqrt(same / w),
        math.sqrt(sum(map(str.__eq__, sentences, sentences[1:])) / max(len(sentences), 1)),
        1 - len(set(lines)) / max(len(lines), 1),
        max(max(tally.values(), default=1) - 1, 0) / w,
        min(1.0, n / w / 40),
        sum(c for x, c in tally.items() if len(x) <= 3) / w,
        math.sqrt(sum(c for x, c in tally.items() if _SYMBOL_WORD.search(x)) / w),
    ]


def _logistic(x):
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float  # ranking score at the chosen quantile
    quantile: float
    slope: float

    def rank(self, rows: np.ndarray) -> np.ndarray:
        return np.clip((rows - self.mean) / self.scale, -8, 8) @ self.weights

    def score(self, rows: np.ndarray) -> np.ndarray:
        if not len(self.weights):
            return np.full(len(rows), 0.5)
        return _logistic(self.slope * (self.rank(rows) - self.cut) + math.log(CUT / (1 - CUT)))


def _pairs_of(size: int):
    """Pairs of a group's rows: the weights of both labels, each in drawn order, are laid side by side, so every row takes part by its weight."""

    def work(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("draw", kind="stable")
        sides = [group[group["label"] == value] for value in (1, 0)]
        if not len(sides[0]) or not len(sides[1]):
            return pd.DataFrame({"apart": [], "weight": [], "label": []})
        ends = [np.cumsum(x["weight"].to_numpy(dtype=np.float64)) for x in sides]
        total = max(e[-1] for e in ends)
        ends = [e * (total / e[-1]) for e in ends]
        for e in ends:
            e[-1] = total
        edges = np.unique(np.concatenate(ends))
        good, bad = (np.stack(x["features"].to_numpy())[np.searchsorted(e, edges, "left")] for x, e in zip(sides, ends))
        # Half of the pairs are turned round, as the regression learns from both outcomes.
        turned = np.arange(len(edges)) % 2
        apart = (good - bad) * np.where(turned, -1.0, 1.0)[:, None]
        return pd.DataFrame({"apart": list(apart.reshape(-1, size)), "weight": np.diff(edges, prepend=0.0), "label": 1.0 - turned})

    return work


def _pairs(rows: DataFrame, counts: dict[int, int], size: int) -> DataFrame:
    """(apart, weight, label) of all pairing rounds over ``rows`` (label, features, weight), of which ``counts`` tells the number."""
    n, scarce = sum(counts.values()), min(counts, key=lambda k: (counts[k], k))
    groups = -(-n // GROUP_ROWS)
    copies = min(groups, -(-SCARCE * groups // counts[scarce]))
    rounds = max(2, min(ROUNDS, PAIRS // n))
    times = F.when(F.col("label") == scarce, F.lit(copies)).otherwise(F.lit(1))
    dealt = (
        rows.withColumn("round", F.explode(F.sequence(F.lit(1), F.lit(rounds))))
        .withColumn("draw", F.xxhash64("features", "round", F.lit(5)))
        .withColumn("copy", F.explode(F.sequence(F.lit(1), times)))
        .select("label", "features", (F.col("weight") / times).alias("weight"), "draw", "round", F.pmod(F.xxhash64("features", "round") + F.col("copy"), F.lit(groups)).alias("part"))
    )
    return dealt.groupBy("round", "part").applyInPandas(_pairs_of(size), "apart array<double>, weight double, label double")


def _scaled(model: Model, size: int) -> Column:
    """The column features as the model scales them."""
    return F.array(*[F.greatest(F.lit(-8.0), F.least(F.lit(8.0), (F.col("features")[k] - F.lit(float(model.mean[k]))) / F.lit(float(model.scale[k])))) for k in range(size)])


def _place_cut(model: Model, rows: DataFrame) -> None:
    """Set the quantile that separates the labels best, and the slope there, from counts of the training scores."""
    ranks = F.pandas_udf(lambda x: pd.Series(model.rank(np.stack(x.to_numpy()))), "double")
    ranked = settle(rows.select("label", "weight", ranks("features").alias("rank")))
    low, high = ranked.agg(F.min("rank"), F.max("rank")).first()
    width = (high - low) / BINS or 1.0
    place = F.least(F.floor((F.col("rank") - F.lit(low)) / F.lit(width)), F.lit(BINS - 1)).cast("int")
    good = F.col("label") == 1
    binned = ranked.groupBy(place.alias("bin")).agg(
        F.min("rank").alias("least"),
        F.max("rank").alias("most"),
        F.sum(F.when(good, F.col("weight")).otherwise(0)).alias("good"),
        F.sum(F.when(good, 0).otherwise(F.col("weight"))).alias("bad"),
        F.coalesce(F.min(F.when(good, F.col("rank"))) + F.max(F.when(good, F.col("rank"))), F.lit(0.0)).alias("good_middle"),
        F.coalesce(F.min(F.when(~good, F.col("rank"))) + F.max(F.when(~good, F.col("rank"))), F.lit(0.0)).alias("bad_middle"),
    )
    got = binned.toPandas().sort_values("bin")  # a row per bin at most
    below_good, below_bad = np.cumsum(got["good"].to_numpy()), np.cumsum(got["bad"].to_numpy())
    below, n = below_good + below_bad, int(below_good[-1] + below_bad[-1])
    if len(got) > 1:
        places = np.unique(np.clip((np.linspace(0, 1, QUANTILES + 1) * n).astype(int), 1, n - 1))
        borders = np.unique(np.clip(np.searchsorted(below, places, "left"), 0, len(got) - 2))
        cuts = (got["most"].to_numpy()[borders] + got["least"].to_numpy()[borders + 1]) / 2
    else:
        borders, cuts = np.array([0]), got["least"].to_numpy()
    right = below_bad[borders] / below_bad[-1] + 1 - below_good[borders] / below_good[-1]
    best = np.flatnonzero(right >= right.max() - 1e-12)
    best = best[len(best) // 2]
    model.cut, model.quantile = float(cuts[best]), float(below[borders[best]] / n)
    odds = math.log(CUT / (1 - CUT))

    def loss(slope: float) -> float:
        chance = [_logistic(slope * (got[side].to_numpy() / 2 - model.cut) + odds) for side in ("good_middle", "bad_middle")]
        return -float(got["good"].to_numpy() @ np.log(chance[0] + 1e-12) + got["bad"].to_numpy() @ np.log(1 - chance[1] + 1e-12))

    model.slope = float(min(np.geomspace(0.1, 10, 41), key=loss))


def _with_features(docs: DataFrame, id_column: str, text: str) -> DataFrame:
    schema = T.StructType([docs.schema[id_column]]).add("features", T.ArrayType(T.DoubleType()))

    def work(batches):
        for batch in batches:
            found = [features(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.float64()))], [id_column, "features"])

    return docs.select(id_column, text).mapInArrow(work, schema)


def fit(docs: DataFrame, labels: DataFrame, trainable: Column, id_column: str = "doc_id", label: str = "quality", text: str = "text") -> Model:
    """Train on all labelled rows that ``trainable`` (over the labels) admits. An id with several labels counts for each."""
    known = labels.filter(trainable & F.col(label).isin(0, 1)).select(id_column, F.col(label).cast("int").alias("label"))
    joined = _with_features(docs, id_column, text).join(known, id_column)  # features meet the labels, so no text is shuffled
    rows = settle(joined.groupBy("label", "features").agg(F.count(F.lit(1)).alias("weight")))
    counts = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    size = len(FEATURES)
    if len(counts) < 2:
        return Model(np.zeros(size), np.ones(size), np.zeros(0), 0.0, 0.0, 0.0)
    of_all = lambda value: F.sum(value * F.col("weight")) / F.sum("weight")
    mean = np.array(rows.agg(*[of_all(F.col("features")[k]) for k in range(size)]).first(), dtype=np.float64)
    spread = rows.agg(*[F.sqrt(of_all((F.col("features")[k] - F.lit(float(mean[k]))) ** 2)) for k in range(size)]).first()
    model = Model(mean, np.array(spread, dtype=np.float64) + 1e-3, np.zeros(size), 0.0, 0.0, 1.0)
    pairs = settle(_pairs(rows.withColumn("features", _scaled(model, size)), counts, size))
    learner = LogisticRegression(featuresCol="apart", labelCol="label", weightCol="weight", fitIntercept=False, standardization=False, regParam=PENALTY, maxIter=200, tol=1e-9)
    model.weights = np.array(learner.fit(pairs.select(array_to_vector("apart").alias("apart"), "weight", "label")).coefficients.toArray())
    _place_cut(model, rows)
    return model


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with quality_score added."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    columns = docs.columns
    schema = extended(docs, "quality_score double")

    def work(batches):
        for batch in batches:
            texts = batch.column(columns.index(text)).to_pylist()
            rows = np.array([features(t or "") for t in texts]).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sent.value.score(rows), pa.float64())], [*columns, "quality_score"])

    return docs.mapInArrow(work, schema)


def keep_good(docs: DataFrame, model: Model, text: str = "text", cut: float = CUT) -> DataFrame:
    """The documents whose score reaches the threshold set by quantile, with all their columns."""
    sent, place = docs.sparkSession.sparkContext.broadcast(model), place_of(docs, text)

    def work(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                rows = np.array([features(t or "") for t in texts_of(part.column(0), place)]).reshape(-1, len(FEATURES))
                yield part.filter(pa.array(~(sent.value.score(rows) < cut)))

    whole = packed_rows(docs)
    return unpacked_rows(whole.mapInArrow(work, whole.schema))
