"""Toxicity: cumulative-link ordinal regression on sparse word features.

One weight per word or word beginning is shared by all grades; ordered thresholds cut the score into grades:
``P(grade <= k) = logistic(threshold[k] - score)``.  The labels only say toxic or not, so the grades of the training
rows are 0 (not toxic), 1 and 2 (toxic, with fewer or at least as many marked words as the middle toxic row), where
marked words are those that set the toxic training rows apart.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewell.llm.features import labelled_sample, word_keys
from tapewell.llm.quality import held_out
from tapewell.llm.words import U, slices

MAX_TRAIN = 8192
LEAST_ROWS = 3  # training rows a word must occur in
LEAST_G2 = 15.0  # evidence (likelihood ratio) that a word's share among toxic rows differs
TOXIC_FROM = 0.25  # probability of grade 1 or more
_BUCKETS = 20


def grades(rows: list[tuple[int, np.ndarray]], size: int) -> np.ndarray:
    """Severity 0, 1 or 2 of each training row (toxic or not, word numbers)."""
    y = np.array([r[0] for r in rows])
    owner = np.repeat(np.arange(len(rows)), [len(r[1]) for r in rows])
    word = np.concatenate([r[1] for r in rows])
    bad, good = (np.bincount(word[y[owner] == k], minlength=size) for k in (1, 0))
    odds = np.log((bad + 0.5) / (y.sum() + 1)) - np.log((good + 0.5) / ((1 - y).sum() + 1))
    marked = (odds > 2) & (bad >= max(LEAST_ROWS, 0.05 * y.sum()))
    marks = np.bincount(owner, weights=marked[word], minlength=len(rows))
    middle = np.median(marks[y == 1]) if y.any() else 0
    return np.where(y == 0, 0, np.where(marks >= middle, 2, 1))


def telling(rows: list[tuple[int, np.ndarray]], size: int) -> np.ndarray:
    """The words with evidence of at least ``LEAST_G2``; the others only add noise to a small sample."""
    y = np.array([r[0] for r in rows])
    owner = np.repeat(np.arange(len(rows)), [len(r[1]) for r in rows])
    word = np.concatenate([r[1] for r in rows])
    total, n = len(rows), np.bincount(word, minlength=size).astype(float)
    score = np.zeros(size)
    for k in (0, 1):
        here = np.bincount(word[y[owner] == k], minlength=size).astype(float)
        for seen, base in ((here, n), ((y == k).sum() - here, total - n)):
            expected = base * (y == k).sum() / total
            score += np.where(seen > 0, seen * np.log(np.maximum(seen, 1e-9) / np.maximum(expected, 1e-9)), 0)
    return np.flatnonzero(2 * score >= LEAST_G2)


def fit(rows: list[tuple[int, np.ndarray]], size: int, epochs: int = 6, rate: float = 0.2, l1: float = 1e-2) -> tuple[np.ndarray, np.ndarray]:
    """Weights and the two ordered thresholds, by per-coordinate adaptive steps with a soft threshold at zero."""
    grade = grades(rows, size)
    w, seen = np.zeros(size), np.full(size, 1e-2)
    first, gap, seen_t = 2.0, 0.5, np.full(2, 1e-2)  # thresholds first and first + exp(gap)
    for _ in range(epochs):
        for (_, word), y in zip(rows, grade, strict=True):
            s = w[word].sum()
            cut = np.array([first, first + np.exp(gap)])
            p = 1 / (1 + np.exp(-np.clip(cut - s, -35, 35)))
            below, above = (p[y - 1] if y else 0.0), (p[y] if y < 2 else 1.0)
            db, da = below * (1 - below), above * (1 - above)
            likely = max(above - below, 1e-9)
            g = -(db - da) / likely  # slope of the loss in the score
            seen[word] += g * g
            step = rate / np.sqrt(seen[word])
            moved = w[word] - step * g
            w[word] = np.sign(moved) * np.maximum(np.abs(moved) - step * l1, 0)
            slope = np.zeros(2)
            if y:
                slope[y - 1] += db / likely
            if y < 2:
                slope[y] -= da / likely
            both = np.array([slope.sum(), slope[1] * np.exp(gap)])
            seen_t += both * both
            first -= rate * both[0] / np.sqrt(seen_t[0])
            gap = np.clip(gap - rate * both[1] / np.sqrt(seen_t[1]), -6, 6)
    return w, np.array([first, first + np.exp(gap)])


def train(sample: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word hashes, weights, thresholds) from the bounded sample (doc_id, text, y); without rows every text is grade 0."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                h, doc = word_keys(part.column(1))
                at = np.searchsorted(doc, np.arange(part.num_rows + 1))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array([h[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())], ["doc_id", "y", "words"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(y, np.frombuffer(k, U)) for b in batches for y, k in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
        if not held:
            return
        every, count = np.unique(np.concatenate([k for _, k in held]), return_counts=True)
        every = every[count >= min(LEAST_ROWS, len(held))]
        rows = []
        for y, k in held:
            at = np.minimum(np.searchsorted(every, k), max(len(every) - 1, 0))
            rows.append((y, at[every[at] == k] if len(every) else at[:0]))
        told = telling(rows, len(every))
        place = np.full(len(every), -1)
        place[told] = np.arange(len(told))
        every, rows = every[told], [(y, place[at][place[at] >= 0]) for y, at in rows]
        w, cut = fit(rows, len(every))
        used = w != 0
        yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (every[used], w[used], cut)], ["words", "weights", "cut"])

    rows = sample.mapInArrow(keys, "doc_id long, y int, words binary").repartition(1).sortWithinPartitions(F.xxhash64("doc_id"))
    found = rows.mapInArrow(learn, "words binary, weights binary, cut binary").collect()  # words of a bounded sample
    if not found:
        return np.zeros(0, U), np.zeros(0), np.array([35.0, 36.0])
    return np.frombuffer(found[0][0], U), np.frombuffer(found[0][1]), np.frombuffer(found[0][2])


def severity(documents: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> DataFrame:
    """``documents`` with ``expected_severity`` (0 to 2), ``grade`` (the likeliest, lower on ties) and ``toxic`` (1 if
    grade 1 or more has a probability of at least ``TOXIC_FROM``).

    All rows stay, repeated ones and null ids included; null and empty texts get the severity of no evidence.  Labels of
    ids in the held-out quarter aren't learned from.  Columns named like the added ones are replaced.
    """
    documents = documents.drop("expected_severity", "grade", "toxic")
    words, weights, cut = train(labelled_sample(documents, labels, "toxic", ~held_out(F.col("doc_id")), max_train))
    model = documents.sparkSession.sparkContext.broadcast((words, weights, cut))
    schema = documents.selectExpr("*", "0.0D as expected_severity", "0 as grade", "0 as toxic").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, weights, cut = model.value
        bucket = np.zeros(1 << _BUCKETS, bool)
        bucket[(words >> U(64 - _BUCKETS)).astype(np.int64)] = True
        for batch in batches:
            for part in slices(batch):
                h, doc = word_keys(part.column(part.schema.get_field_index("text")), bucket, _BUCKETS)
                at = np.minimum(np.searchsorted(words, h), max(len(words) - 1, 0))
                hit = words[at] == h if len(words) else np.zeros(len(h), bool)
                s = np.bincount(doc[hit], weights=weights[at[hit]], minlength=part.num_rows)
                below = 1 / (1 + np.exp(-np.clip(cut[None, :] - s[:, None], -35, 35)))  # P(grade <= 0), P(grade <= 1)
                each = np.stack([below[:, 0], below[:, 1] - below[:, 0], 1 - below[:, 1]], axis=1)
                out = [pa.array((1 - below).sum(axis=1)), pa.array(each.argmax(axis=1).astype(np.int32)), pa.array((below[:, 0] <= 1 - TOXIC_FROM).astype(np.int32))]
                yield pa.RecordBatch.from_arrays([*part.columns, *out], [f.name for f in schema])

    return documents.mapInArrow(run, schema)
