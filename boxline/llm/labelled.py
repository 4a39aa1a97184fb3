"""Labelled rows, bounded samples of them, and calibration of a score to a probability."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxline.llm.common import fold, text_of

_SPACE = 1_000_003
_BROADCAST_IDS = 300_000  # about 5 MB


def labelled_ids(labels: DataFrame, column: str) -> DataFrame:
    """All ids outside the held-out fold: ``doc_id``, ``target`` (0 or 1) and ``fold``.

    An id with several labels counts once, by their majority (a tie is 1); null
    ids and labels are left out.
    """
    clean = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(f"`{column}`").cast("double").alias("label")).where("doc_id is not null and label is not null")
    one = clean.where(fold(F.col("doc_id")) != 0).groupBy("doc_id").agg((F.avg("label") >= 0.5).cast("int").alias("target"))
    return one.withColumn("fold", fold(F.col("doc_id")))


def sample_ids(labels: DataFrame, column: str, per_class: int) -> tuple[DataFrame, dict[int, float]]:
    """About ``per_class`` ids of each class of ``labelled_ids``, and the share of each class that was taken.

    The choice goes by a hash of the id, so it is the same each time.
    """
    one = labelled_ids(labels, column)
    counts = {r["target"]: r["n"] for r in one.groupBy("target").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = {c: min(1.0, per_class / n) for c, n in counts.items()}
    place = F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(_SPACE))
    taken = F.lit(False)
    for target, part in share.items():
        taken |= (F.col("target") == target) & (place < part * _SPACE)
    return one.where(taken), share


def labelled_texts(docs: DataFrame, ids: DataFrame, text: str) -> DataFrame:
    """Whole texts of any number of labelled ids: ``target``, ``fold``, ``text``. The ids are broadcast while they are few."""
    if ids.count() <= _BROADCAST_IDS:
        ids = F.broadcast(ids)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(F.col(f"`{text}`")).alias("text"))
    return slim.join(ids, "doc_id").select("target", "fold", "text")


def sample_texts(docs: DataFrame, sample: DataFrame, text: str) -> DataFrame:
    """Whole texts of sampled ids: ``target``, ``fold``, ``text``. The broadcast side is bounded by the sample's size."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(F.col(f"`{text}`")).alias("text"))
    return slim.join(F.broadcast(sample), "doc_id").select("target", "fold", "text")


def platt(scores: np.ndarray, target: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of a weighted logistic fit by Newton steps, lightly regularised."""
    scale = float(scores.std()) or 1.0
    x = np.stack([scores / scale, np.ones_like(scores)], axis=1)
    weight = weight / weight.mean()
    beta, ridge = np.zeros(2), np.diag([1e-2, 1e-6])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -35, 35)))
        gradient = x.T @ (weight * (p - target)) + ridge @ beta
        step = np.linalg.solve(x.T @ (x * (weight * np.maximum(p * (1 - p), 1e-9))[:, None]) + ridge, gradient)
        size = np.abs(step).max()
        beta -= step * min(1.0, 5.0 / size) if size else step
        if size < 1e-9:
            break
    return float(beta[0] / scale), float(beta[1])


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -700, 700)))


def platt_of(rows: DataFrame) -> tuple[float, float]:
    """``platt`` over all rows of a frame with ``score`` and ``target``, however many: each Newton step is one aggregate.

    Sums are taken of decimals, so they do not depend on the order of rows.
    Rows of one class only give no slope and that class's share, one half without rows.
    """
    total = lambda c: F.coalesce(F.sum(c.cast("decimal(38,18)")), F.lit(0)).cast("double")
    n, ones, mean, square = rows.agg(F.count(F.lit(1)), F.sum("target"), total(F.col("score")), total(F.col("score") * F.col("score"))).first()
    if not n or ones in (0, n):
        rate = min(max(ones / n if n else 0.5, 1e-6), 1 - 1e-6)
        return 0.0, float(np.log(rate / (1 - rate)))
    scale = float(np.sqrt(max(square / n - (mean / n) ** 2, 0.0))) or 1.0
    x = F.col("score") / scale
    beta, ridge = np.zeros(2), np.diag([1e-2, 1e-6])
    for _ in range(60):
        at = F.least(F.greatest(x * float(beta[0]) + float(beta[1]), F.lit(-35.0)), F.lit(35.0))
        p = 1 / (1 + F.exp(-at))
        off, bend = p - F.col("target"), F.greatest(p * (1 - p), F.lit(1e-9))
        a, b, xx, x1, one = rows.agg(*(total(c) for c in (off * x, off, bend * x * x, bend * x, bend))).first()
        step = np.linalg.solve(np.array([[xx, x1], [x1, one]]) + ridge, np.array([a, b]) + ridge @ beta)
        size = np.abs(step).max()
        beta -= step * min(1.0, 5.0 / size) if size else step
        if size < 1e-7:
            break
    return float(beta[0] / scale), float(beta[1])
