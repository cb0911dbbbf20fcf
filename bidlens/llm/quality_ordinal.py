"""Graded quality by cumulative-link regression: one weight vector over hashed text, ordered thresholds between grades."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from bidlens.llm.common import BATCH_BYTES, documents, is_held_out, rows_of, text_words
from bidlens.llm.training import labelled_sample, sampled_texts

TRAINING_ROWS = 3_000  # of each grade
BUCKETS = 2048
EPOCHS = 300
STEP = 0.05
RIDGE = 1e-4
# Grades of the labels: 0 low quality, 1 good but toxic, 2 good and not toxic.
GRADES = 3
# A text is kept if its grade is at least KEEP_GRADE with at least this probability.
KEEP_GRADE = 1
KEEP_PROBABILITY = 0.5
SCHEMA = "doc_id long, held_out boolean, expected_grade double, tail_probability double, kept boolean"


def features(texts: list[str]) -> np.ndarray:
    """Per text the square roots of the shares of hashed byte triples, and the share of words that repeat the one before.

    A text beyond a megabyte is counted part by part.
    """
    out = np.zeros((len(texts), BUCKETS + 1), np.float32)
    for row, text in enumerate(texts):
        data = np.frombuffer(text.encode(), np.uint8)
        counts = np.zeros(BUCKETS)
        for at in range(0, max(0, len(data) - 2), BATCH_BYTES):
            part = data[at:at + BATCH_BYTES + 2].astype(np.uint32)
            code = (part[:-2] << np.uint32(16) | part[1:-1] << np.uint32(8) | part[2:]) * np.uint32(2654435761)
            counts += np.bincount(code >> np.uint32(21), minlength=BUCKETS)
        if total := counts.sum():
            out[row, :-1] = np.sqrt(counts / total)
    for row, words in enumerate(text_words(texts)):
        if len(words) > 1:
            out[row, -1] = (words[1:] == words[:-1]).mean()
    return out


@dataclass
class Model:
    weights: np.ndarray
    thresholds: np.ndarray  # rising; P(grade > k) = s(weights . x - thresholds[k])

    def tails(self, x: np.ndarray) -> np.ndarray:
        """P(grade >= 1), P(grade >= 2), ... of each row."""
        score = (x * self.weights).sum(axis=1, dtype=np.float64)
        return 1 / (1 + np.exp(-np.clip(score[:, None] - self.thresholds, -30, 30)))


def fit(x: np.ndarray, grade: np.ndarray, weight: np.ndarray, epochs: int = EPOCHS) -> Model:
    """Maximum likelihood of the grades with a small ridge, by Adam steps over all rows.

    Thresholds are a first one and positive gaps, so they stay ordered.
    """
    if not len(x):
        return Model(np.zeros(x.shape[1], np.float32), np.zeros(GRADES - 1))
    weight = weight / weight.sum()
    share = np.array([weight[grade > k].sum() for k in range(GRADES - 1)]).clip(1e-3, 1 - 1e-3)
    cuts = np.maximum.accumulate(-np.log(share / (1 - share)) + 1e-3 * np.arange(GRADES - 1))
    theta = np.concatenate([np.zeros(x.shape[1]), cuts[:1], np.log(np.maximum(np.diff(cuts), 1e-3))])
    d = x.shape[1]
    first, second = np.zeros_like(theta), np.zeros_like(theta)

    def cut_points(t):
        return t[d] + np.concatenate([[0.0], np.cumsum(np.exp(t[d + 1:]))])

    for epoch in range(1, epochs + 1):
        score = x @ theta[:d].astype(np.float32)
        tail = 1 / (1 + np.exp(-np.clip(score[:, None] - cut_points(theta), -30, 30)))
        upper = np.hstack([np.ones((len(x), 1)), tail])
        lower = np.hstack([tail, np.zeros((len(x), 1))])
        rows = np.arange(len(x))
        p = np.maximum(upper[rows, grade] - lower[rows, grade], 1e-9)
        slope = np.hstack([np.zeros((len(x), 1)), tail * (1 - tail), np.zeros((len(x), 1))])
        # d log p / d score, and / d cut k.
        by_score = weight * (slope[rows, grade] - slope[rows, grade + 1]) / p
        by_cut = np.zeros((len(x), GRADES + 1))
        by_cut[rows, grade] -= weight * slope[rows, grade] / p
        by_cut[rows, grade + 1] += weight * slope[rows, grade + 1] / p
        cut_slope = by_cut[:, 1:GRADES].sum(axis=0)
        gaps = np.exp(theta[d + 1:])
        gradient = -np.concatenate([
            x.T @ by_score.astype(np.float32) - RIDGE * theta[:d], [cut_slope.sum()],
            [gaps[k] * cut_slope[k + 1:].sum() for k in range(GRADES - 2)],
        ])
        first = 0.9 * first + 0.1 * gradient
        second = 0.999 * second + 0.001 * gradient ** 2
        theta -= STEP * (first / (1 - 0.9 ** epoch)) / (np.sqrt(second / (1 - 0.999 ** epoch)) + 1e-8)
    return Model(theta[:d].astype(np.float32), cut_points(theta))


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Model from at most about ``rows`` labelled texts of each grade; held-out rows are never read."""
    grade = F.when(F.col("quality") == 0, 0).when((F.col("quality") == 1) & F.col("toxic").isin(0, 1), 2 - F.col("toxic"))

    def read(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                x = features(part.column("text").to_pylist()).astype(np.float16)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("label"), part.column("weight"), pa.array([r.tobytes() for r in x], pa.binary())],
                    names=["doc_id", "label", "weight", "x"],
                )

    sampled = sampled_texts(documents(docs, id_col, text_col), labelled_sample(labels, grade, rows))
    # Bounded: ``rows`` texts of each grade, two bytes for each bucket.
    found = sampled.mapInArrow(read, "doc_id long, label int, weight double, x binary").toPandas().sort_values(["doc_id", "x"], kind="stable")
    x = np.zeros((len(found), BUCKETS + 1), np.float32)
    for k, data in enumerate(found["x"]):
        x[k] = np.frombuffer(data, np.float16)
    return fit(x, found["label"].to_numpy(int), found["weight"].to_numpy(float))


def graded_quality(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, expected_grade, tail_probability, kept) of every whole text, one row per input row.

    ``expected_grade`` is between 0 and 2, ``tail_probability`` that of a grade of at least
    ``KEEP_GRADE``, ``kept`` whether it reaches ``KEEP_PROBABILITY``. Null and empty texts
    are scored by the thresholds alone; without labels all probabilities are one half;
    rows with other labels are not used; repeated rows are scored each.
    """
    model = train(docs, labels, rows, id_col, text_col)

    def score(batches):
        for ids, texts in rows_of(batches):
            tails = model.tails(features(texts))
            tail = tails[:, KEEP_GRADE - 1]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array([is_held_out(i) for i in ids]), pa.array(tails.sum(axis=1)), pa.array(tail), pa.array(tail >= KEEP_PROBABILITY)],
                names=["doc_id", "held_out", "expected_grade", "tail_probability", "kept"],
            )

    return documents(docs, id_col, text_col).mapInArrow(score, SCHEMA)
