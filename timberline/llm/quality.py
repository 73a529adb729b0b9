"""Quality classifier: a regularised quadratic discriminant on document statistics.

Statistics of a whole text (ratios of byte classes, word and line repetition,
lengths) are transformed by logs and logits. Each class has a mean and a
covariance that is shrunk towards the pooled one and towards its diagonal. A
text's score is the logistic of the difference of the two Gaussian log
densities plus the log prior ratio; squared Mahalanobis distances come from
triangular solves with Cholesky factors that are computed once.

Training keeps, per class, a count, sums and cross products, added up by Spark
over every labelled training row; the driver sees only those.

Defined results: null text counts as empty; an empty text gets a score like
any other. With labels of one class only, or none, all scores are that class's
share (0.5 without labels). A doc_id labelled twice counts twice.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import lower, text_blocks, word_hashes, word_spans

STATISTICS = [
    "log_bytes", "log_words", "word_length", "upper", "digits", "symbols", "shouts", "stops", "wide", "breaks",
    "distinct_words", "distinct_pairs", "top_word", "symbol_ends", "repeated_symbols", "line_length",
]

UPPER, DIGIT, WIDE, STOP, SHOUT, SYMBOL = (np.zeros(256, dtype=bool) for _ in range(6))
UPPER[0x41:0x5B] = True
DIGIT[0x30:0x3A] = True
WIDE[0x80:] = True
STOP[list(b".,;:?")] = True
SHOUT[list(b"!")] = True
SYMBOL[[b for b in range(0x21, 0x7F) if not chr(b).isalnum() and chr(b) not in ".,;:?!'\"-"]] = True


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of transformed statistics per text."""
    docs = len(offsets) - 1
    sizes = np.diff(offsets).astype(float)
    starts, ends, rows = word_spans(data, offsets)
    words = np.bincount(rows, minlength=docs).astype(float)

    def share(mask: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(mask)])
        return (sums[offsets[1:]] - sums[offsets[:-1]] + 0.5) / (sizes + 20)

    def logit(x: np.ndarray) -> np.ndarray:
        x = np.clip(x, 1e-4, 1 - 1e-4)
        return np.log(x / (1 - x))

    def distinct(keys: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of different keys, and the count of the commonest, in each text."""
        order = np.lexsort((keys, of))
        new = np.ones(len(order), dtype=bool)
        new[1:] = (np.diff(keys[order]) != 0) | (np.diff(of[order]) != 0)
        firsts = np.flatnonzero(new)
        top = np.zeros(docs)
        np.maximum.at(top, of[order][firsts], np.diff(np.append(firsts, len(order))))
        return np.bincount(of[order][firsts], minlength=docs).astype(float), top

    hashes, _ = word_hashes(lower(data), offsets)
    single, top = distinct(hashes, rows)
    paired = np.flatnonzero(rows[1:] == rows[:-1]) if len(rows) else np.zeros(0, int)
    pairs, _ = distinct(hashes[paired] * np.uint64(3) + hashes[paired + 1], rows[paired])
    last = data[ends - 1]
    odd = np.bincount(rows, weights=SYMBOL[last] | SHOUT[last], minlength=docs)
    again = np.zeros(len(data), dtype=bool)
    again[1:] = (data[1:] == data[:-1]) & (SYMBOL | SHOUT | STOP)[data[1:]]
    inner = offsets[:-1]
    again[inner[inner < len(data)]] = False  # the byte before is another text's
    breaks = share(data == 10)
    return np.stack([
        np.log1p(sizes), np.log1p(words), np.log1p(sizes / np.maximum(1, words)),
        logit(share(UPPER[data])), logit(share(DIGIT[data])), logit(share(SYMBOL[data])), logit(share(SHOUT[data])), logit(share(STOP[data])), logit(share(WIDE[data])), logit(breaks),
        logit((single + 1) / (words + 2)), logit((pairs + 1) / (np.maximum(0, words - 1) + 2)), logit((top + 0.5) / (words + 10)),
        logit((odd + 0.5) / (words + 10)), logit(share(again)), np.log1p(sizes * (1 - breaks) / (sizes * breaks + 1)),
    ], axis=1)


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, x): the transformed statistics of every whole text."""

    def run(batches):
        for batch in batches:
            for a, b, data, offsets in text_blocks(batch.column("text"), lowered=False):
                x = statistics(data, offsets)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[a:b], pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))], ["doc_id", "x"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, x array<double>")


def class_moments(rows: DataFrame) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """Count, sum and cross products of x for each label of (label, x) rows."""
    d = len(STATISTICS)

    def run(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            labels = batch.column("label").to_numpy(zero_copy_only=False)
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            for label in np.unique(labels):
                mine = np.column_stack([np.ones((labels == label).sum()), x[labels == label]])
                sums[int(label)] = sums.get(int(label), 0) + mine.T @ mine
        for label, total in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([label] * total.size, pa.int32()), pa.array(np.arange(total.size), pa.int32()), pa.array(total.ravel())], ["label", "slot", "value"])

    added = rows.select(F.col("label").cast("int").alias("label"), "x").mapInArrow(run, "label int, slot int, value double").groupBy("label", "slot").agg(F.sum("value").alias("value"))
    found: dict[int, np.ndarray] = {}
    for label, slot, value in added.collect():  # (d + 1)^2 numbers a class
        found.setdefault(label, np.zeros((d + 1) ** 2))[slot] = value
    return {k: (v[0], v[1 : d + 1], v.reshape(d + 1, d + 1)[1:, 1:]) for k, v in found.items()}


class Discriminant:
    """Two Gaussians with shrunk covariances."""

    def __init__(self, moments: dict, to_pooled: float = 0.1, to_diagonal: float = 0.02, temperature: float = 1.0):
        total = sum(m[0] for m in moments.values())
        self.prior = moments[1][0] / total if 1 in moments else 0.0 if 0 in moments else 0.5
        self.temperature, self.classes = temperature, None
        if not all(k in moments and moments[k][0] > 1 for k in (0, 1)):
            return
        means = {k: s / n for k, (n, s, _) in moments.items()}
        scatter = {k: c - n * np.outer(means[k], means[k]) for k, (n, _, c) in moments.items()}
        pooled = sum(scatter[k] for k in (0, 1)) / total
        self.classes = []
        for k in (0, 1):
            own = (1 - to_pooled) * scatter[k] / moments[k][0] + to_pooled * pooled
            own = (1 - to_diagonal) * own + to_diagonal * np.diag(np.diag(pooled)) + 1e-6 * np.eye(len(own))
            factor = np.linalg.cholesky(own)
            self.classes.append((means[k], np.linalg.inv(factor), 2 * np.log(np.diag(factor)).sum()))

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.classes is None:
            return np.full(len(x), float(self.prior))
        logs = [-0.5 * (((x - mean) @ inverse.T) ** 2).sum(axis=1) - 0.5 * logdet for mean, inverse, logdet in self.classes]
        z = (logs[1] - logs[0] + np.log(self.prior / (1 - self.prior))) / self.temperature
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def score_quality(features: DataFrame, model: Discriminant, threshold: float = 0.3) -> DataFrame:
    """doc_id, score, predicted for (doc_id, x) rows."""

    def run(batches):
        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.scores(x))], ["doc_id", "score"])

    return features.mapInArrow(run, "doc_id long, score double").withColumn("predicted", (F.col("score") >= threshold).cast("int"))
