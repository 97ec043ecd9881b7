"""Language identification by averaged hashed subword embeddings with a linear softmax.

A text's lower-cased UTF-8 bytes, with digits and signs read as one space, give all byte 3- and
4-grams; each is hashed to one of ``buckets`` rows of an embedding table. A text is the mean of its
rows, and a linear softmax over it gives the languages. Both tables are trained by stochastic gradient
descent in numpy. As mean and softmax input are linear, table times weights is multiplied out once:
predicting costs one lookup per gram. A temperature, fitted on documents kept out of training,
calibrates the probabilities, and the same documents set the least probability at which a prediction
is not rejected.

Training uses at most ``MAX_TRAINING_ROWS`` labelled documents (those with the smallest hash of id
and text), each as the counts of its hashed grams over its whole text, made on the executors. The model
(``buckets`` x languages, under 1 MB for four) goes to the tasks that predict whole texts one by one.

Defined cases: a text that is null or has no letter is ``und`` with score 0; without any labelled row
everything is ``und``; with one label only, that one is predicted; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidecast.llm.common import extended, fold

BUCKETS = 1 << 14
DIMENSIONS = 16
MAX_TRAINING_ROWS = 2000
EPOCHS = 12
UNKNOWN = "und"
#: The calibrated probability below which a prediction counts as rejected keeps this share of validation rows.
KEPT_SHARE = 0.999

_LETTER = re.compile(r"[^\W\d_]")
#: ASCII signs, digits and control characters are one kind of space.
_FOLD = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))
_SEGMENT = 1 << 20


def grams(text: str, buckets: int = BUCKETS):
    """Arrays of hashed 3- and 4-grams, a segment of the text at a time."""
    raw = np.frombuffer((" " + text.lower() + " ").encode("utf-8", "replace").translate(_FOLD), dtype=np.uint8)
    shift = np.uint32(32 - (buckets.bit_length() - 1))
    for at in range(0, max(len(raw) - 2, 1), _SEGMENT):
        b = raw[at : at + _SEGMENT + 3].astype(np.uint32)
        if len(b) < 3:
            return
        three = b[:-2] | (b[1:-1] << np.uint32(8)) | (b[2:] << np.uint32(16))
        three = three[:_SEGMENT]
        yield (three * np.uint32(2654435761)) >> shift
        four = three[: len(b) - 3] | (b[3:] << np.uint32(24))[: len(three)]
        yield (four * np.uint32(2246822519) + np.uint32(374761393)) >> shift


def counts(text: str, buckets: int = BUCKETS) -> np.ndarray:
    total = np.zeros(buckets, dtype=np.int64)
    for g in grams(text, buckets):
        total += np.bincount(g, minlength=buckets)
    return total


def has_letter(text: str | None) -> bool:
    return text is not None and _LETTER.search(text) is not None


@dataclass
class Model:
    languages: list[str]
    scores: np.ndarray  # buckets x languages
    bias: np.ndarray
    temperature: float
    least: float

    def logits(self, text: str) -> np.ndarray:
        """Sum over grams of the table's rows, as counts per bucket times the table."""
        n = counts(text, len(self.scores))
        return n @ self.scores / max(n.sum(), 1) + self.bias

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, calibrated probability, rejected)"""
        if not self.languages or not has_letter(text):
            return UNKNOWN, 0.0, True
        p = softmax(self.logits(text) / self.temperature)
        best = int(np.argmax(p))
        return self.languages[best], float(p[best]), bool(p[best] < self.least)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def _labelled_grams(docs: DataFrame, label: str, text: str, id_column: str, trainable: Column, limit: int, buckets: int) -> DataFrame:
    """label, and the hashed grams of the text with their counts."""
    able = docs.filter(trainable & F.col(label).isNotNull() & F.col(text).isNotNull())
    mark = F.xxhash64(F.col(id_column), F.col(text), F.lit(7))
    last = able.select(mark.alias("mark")).orderBy("mark").limit(limit).agg(F.max("mark").alias("last"))
    chosen = (
        able.filter(mark <= last.scalar())  # hashes are ordered first, so that texts beyond the sample stay where they are
        .select(F.col(label).cast("string").alias("label"), F.col(text).alias("text"))
        .limit(limit)
    )

    def work(batches):
        for batch in batches:
            found = [counts(t, buckets) for t in batch.column(1).to_pylist()]
            at = [np.flatnonzero(n) for n in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([a.astype(np.int32) for a in at], pa.list_(pa.int32())), pa.array([n[a] for n, a in zip(found, at)], pa.list_(pa.int64()))],
                ["label", "at", "n"],
            )

    return chosen.mapInArrow(work, "label string, at array<int>, n array<long>")


def fit(docs: DataFrame, trainable: Column, label: str = "lang", text: str = "text", id_column: str = "doc_id", limit: int = MAX_TRAINING_ROWS, buckets: int = BUCKETS, dimensions: int = DIMENSIONS, epochs: int = EPOCHS, seed: int = 11) -> Model:
    """Train on the labelled rows that ``trainable`` admits."""
    rows = _labelled_grams(docs, label, text, id_column, trainable, limit, buckets).toArrow()
    labels, at, n = rows.column("label").to_pylist(), rows.column("at").to_pylist(), rows.column("n").to_pylist()
    keep = [k for k in range(len(labels)) if len(at[k])]
    languages = sorted({labels[k] for k in keep})
    if not languages:
        return Model([], np.zeros((buckets, 0)), np.zeros(0), 1.0, 0.0)
    examples = [(np.array(at[k]), np.array(n[k], dtype=np.float64) / sum(n[k]), languages.index(labels[k])) for k in keep]
    rng = np.random.default_rng(seed)
    rng.shuffle(examples)
    held = examples[::5] if len(examples) >= 50 else []
    train = [e for k, e in enumerate(examples) if k % 5] if held else examples
    table = rng.normal(0, 0.1, (buckets, dimensions))
    weights, bias = np.zeros((dimensions, len(languages))), np.zeros(len(languages))
    for epoch in range(epochs):
        rate = 4.0 * (1 - epoch / epochs)
        for k in rng.permutation(len(train)):
            where, share, y = train[k]
            mean = share @ table[where]
            error = softmax(mean @ weights + bias)
            error[y] -= 1
            back = weights @ error
            weights -= rate * np.outer(mean, error)
            bias -= 0.1 * rate * error
            table[where] -= rate * share[:, None] * back
    model = Model(languages, (table @ weights), bias, 1.0, 0.0)
    if held:
        logits = np.array([share @ model.scores[where] + bias for where, share, _ in held])
        truth = np.array([y for _, _, y in held])
        loss = lambda t: -np.log(softmax(logits / t)[np.arange(len(truth)), truth] + 1e-12).mean()
        model.temperature = float(min(np.geomspace(0.25, 8, 41), key=loss))
        right = softmax(logits / model.temperature).max(axis=1)
        model.least = float(np.quantile(right, 1 - KEPT_SHARE))
    return model


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred, score and rejected added."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    columns = docs.columns
    schema = extended(docs, "lang_pred string, score double, rejected boolean")

    def work(batches):
        for batch in batches:
            found = [sent.value.predict(t) for t in batch.column(columns.index(text)).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()), pa.array([f[2] for f in found], pa.bool_())],
                [*columns, "lang_pred", "score", "rejected"],
            )

    return docs.mapInArrow(work, schema)


def identify(docs: DataFrame, folds: int = 4, held_out: int = 2, id_column: str = "doc_id") -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected; learned from the rows outside the held-out fold."""
    out = fold(id_column, folds) == held_out
    model = fit(docs, ~out, id_column=id_column)
    inputs = docs.select(F.col(id_column), out.alias("held_out"), "text")
    return predict(inputs, model).drop("text")
