"""Quality classifier: naive Bayes support vectors.

Binary indicators of n-grams are scaled by the log ratio of their class counts,
and a linear hinge-loss model over them is fitted by dual coordinate descent.
N-grams are single words, and one to three consecutive token shapes (case,
digits, repeats, the punctuation itself), which carry over to unseen words.
They are hashed to a fixed number of places, so the model has a fixed size.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from boxline.llm.common import document_columns, fold
from boxline.llm.labelled import platt, sample_ids, sample_texts, sigmoid

PLACES = 1 << 18
PER_CLASS = 4000  # labelled rows of each class that the fit reads, about
THRESHOLD = 0.3

_TOKEN = re.compile(r"\w+|[^\w\s]+|\n")
_SEEN = 200_000  # words kept in a task's lookup; a full one starts anew


def _shape(token: str) -> str:
    if token.isalpha():
        kind = "A" if token.isupper() else "T" if token[0].isupper() else "a"
        return kind + str(min(len(token) // 6, 3))
    if token.isdigit():
        return "0"
    return token[:4] if not token[0].isalnum() else "x"


class _Codes(dict):
    """Token to hash of its word (upper half) and of its shape (lower half); bounded, a full one starts anew."""

    def __missing__(self, token: str) -> int:
        if len(self) >= _SEEN:
            self.clear()
        word, shape = (zlib.crc32(x.encode("utf-8", "surrogatepass")) for x in (token.lower(), _shape(token)))
        code = self[token] = word << 32 | shape
        return code


class Indicators:
    """Maps a text to the sorted distinct places of its n-grams."""

    def __init__(self):
        self.codes = _Codes()

    def __call__(self, text: str) -> np.ndarray:
        tokens = _TOKEN.findall(text)
        if not tokens:
            return np.empty(0, np.int32)
        codes = np.fromiter(map(self.codes.__getitem__, tokens), np.uint64, len(tokens))
        words, shapes = codes >> np.uint64(32), codes & np.uint64(0xFFFFFFFF)
        # A token that repeats the one before has the shape "repeat".
        shapes[1:][words[1:] == words[:-1]] = np.uint64(7)
        one = shapes * np.uint64(0x9E3779B97F4A7C15)
        two = (one[:-1] ^ (one[:-1] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + one[1:]
        three = (two[:-1] ^ (two[:-1] >> np.uint64(31))) * np.uint64(0x94D049BB133111EB) + one[2:]
        grams = np.concatenate([words * np.uint64(0xD6E8FEB86659FD93), one, two + np.uint64(2), three + np.uint64(3)])
        return np.unique((grams >> np.uint64(64 - 18)).astype(np.int32))


@dataclass
class Model:
    """Weights per place; the margin of a text is their sum over its places, divided by the root of their number."""

    weights: np.ndarray
    bias: float
    slope: float
    intercept: float

    def margin(self, places: np.ndarray) -> float:
        return float(self.weights[places].sum() / np.sqrt(max(len(places), 1))) + self.bias

    def score(self, margins: np.ndarray) -> np.ndarray:
        return sigmoid(self.slope * margins + self.intercept)


def log_count_ratio(rows: list[np.ndarray], target: np.ndarray, smoothing: float = 1.0) -> np.ndarray:
    counts = np.full((2, PLACES), smoothing)
    for places, t in zip(rows, target):
        counts[int(t), places] += 1
    return np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())


def dual_coordinate_descent(rows: list[np.ndarray], values: list[np.ndarray], target: np.ndarray, cost: np.ndarray, sweeps: int = 20, seed: int = 1) -> tuple[np.ndarray, float]:
    """Weights and bias of min 1/2 |w|^2 + sum cost_i max(0, 1 - y_i (w x_i + b)); the bias is one more weight."""
    weights, bias, y = np.zeros(PLACES), 0.0, 2.0 * target - 1
    alpha, diagonal = np.zeros(len(rows)), np.array([float(v @ v) + 1 for v in values])
    order = np.random.default_rng(seed)
    for _ in range(sweeps):
        most = 0.0
        for i in order.permutation(len(rows)):
            gradient = y[i] * (weights[rows[i]] @ values[i] + bias) - 1
            new = min(max(alpha[i] - gradient / diagonal[i], 0.0), cost[i])
            if change := (new - alpha[i]) * y[i]:
                weights[rows[i]] += change * values[i]
                bias += change
                most = max(most, abs(new - alpha[i]) / cost[i])
                alpha[i] = new
        if most < 1e-3:
            break
    return weights, bias


def fit(rows: list[np.ndarray], target: np.ndarray, folds: np.ndarray, share: dict[int, float], cost: float = 0.1, mix: float = 0.5) -> Model:
    """Model from sampled rows; the last fold calibrates, the others train.

    ``mix`` draws the support vectors' weights towards their mean size, as the
    interpolation with plain naive Bayes does. Without rows of both classes the
    score is the share of ones (0.5 without any rows).
    """
    weight = np.array([1 / share.get(int(t), 1.0) for t in target])
    last = folds == folds.max() if len(folds) else np.zeros(0, bool)
    if len(set(target[~last])) < 2:
        rate = float((weight * target).sum() / weight.sum()) if len(target) else 0.5
        rate = min(max(rate, 1e-6), 1 - 1e-6)
        return Model(np.zeros(PLACES), 0.0, 0.0, float(np.log(rate / (1 - rate))))
    train = [r for r, x in zip(rows, last) if not x]
    ratio = log_count_ratio(train, target[~last])
    values = [ratio[r] / np.sqrt(max(len(r), 1)) for r in train]
    balance = np.where(target[~last] == 1, 1 / max((target[~last] == 1).mean(), 1e-9), 1 / max((target[~last] == 0).mean(), 1e-9)) / 2
    fitted, bias = dual_coordinate_descent(train, values, target[~last], cost * balance)
    mixed = (1 - mix) * np.abs(fitted).mean() + mix * fitted
    model = Model(mixed * ratio, mix * bias, 1.0, 0.0)
    held = last if len(set(target[last])) == 2 else ~last
    margins = np.array([model.margin(r) for r, x in zip(rows, held) if x])
    model.slope, model.intercept = platt(margins, target[held].astype(float), weight[held])
    return model


def train(docs: DataFrame, labels: DataFrame, text: str = "text", column: str = "quality", per_class: int = PER_CLASS) -> Model:
    """Fit on about ``per_class`` labelled rows of each class outside the held-out fold; only their places reach the driver."""
    sample, share = sample_ids(labels, column, per_class)

    def run(batches):
        indicators = Indicators()
        for batch in batches:
            places = [indicators(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(places, pa.list_(pa.int32()))], ["target", "fold", "places"])

    found = sample_texts(docs, sample, text).mapInArrow(run, "target int, fold int, places array<int>").toArrow()
    rows = [np.asarray(p.values, np.int32) for p in found["places"]]
    order = sorted(range(len(rows)), key=lambda i: rows[i].tobytes())  # the same model whatever order rows come in
    target, folds = np.asarray(found["target"], np.int64)[order], np.asarray(found["fold"], np.int64)[order]
    return fit([rows[i] for i in order], target, folds, share)


def score(docs: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``_doc`` (the row), ``score`` and ``predicted`` of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias, model.slope, model.intercept))

    def run(batches):
        indicators, held = Indicators(), Model(*shared.value)
        for batch in batches:
            margins = np.array([held.margin(indicators(t or "")) for t in batch.column(0).field(text).to_pylist()], float)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(held.score(margins))], ["_doc", "score"])

    rows = docs.select(F.struct(*document_columns(docs)).alias("_doc"))
    schema = T.StructType([*rows.schema, T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(run, schema).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def score_documents(docs: DataFrame, labels: DataFrame, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted`` per document.

    Labels are learned only from rows outside fold 0, and only words and marks
    of the text enter a score. Null text counts as empty and gets the score of
    a text without n-grams; null ids count as held out; repeated rows stay.
    """
    model = train(docs, labels, text)
    slim = docs.select("doc_id", F.col(f"`{text}`").alias("text"))
    return score(slim, model, "text", threshold).select("_doc.doc_id", (fold(F.col("_doc.doc_id")) == 0).alias("held_out"), "score", "predicted")


def keep_good(docs: DataFrame, labels: DataFrame, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Rows whose predicted class is 1, with all their columns."""
    kept = score(docs, train(docs, labels, text), text, threshold).where("predicted = 1")
    return kept.select(*(F.col("_doc").getField(name).alias(name) for name in docs.columns))
