"""Quality classifier: hashed word n-gram logistic regression trained with follow-the-regularised-leader updates."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapewell.llm.features import DIM, labelled_sample, ngram_features, sparse_rows
from tapewell.llm.words import slices

THRESHOLD = 0.7
MAX_TRAIN = 8192
SCALE = 20.0  # features are shares of a text's tokens; this brings them to the size of the bias


def ftrl(rows: list[tuple[int, np.ndarray, np.ndarray]], epochs: int = 4, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.02, l2: float = 0.05) -> np.ndarray:
    """Per-coordinate FTRL-proximal over sparse rows (label, slots, values); the last weight is the bias.

    Rows hold shares as they come; each is scaled and given its bias when its turn is there, not all at once.  The leader's weights are read off the accumulated gradients ``z`` and squared gradients ``n``; coordinates whose
    ``z`` stays within ``l1`` are exactly zero.
    """
    z, n = np.zeros(DIM + 1), np.zeros(DIM + 1)

    def leader(slot: np.ndarray) -> np.ndarray:
        zs = z[slot]
        w = -(zs - np.sign(zs) * l1) / ((beta + np.sqrt(n[slot])) / alpha + l2)
        return np.where(np.abs(zs) <= l1, 0.0, w)

    for _ in range(epochs):
        for y, own, share in rows:
            slot, value = np.append(own, DIM), np.append(share * np.float32(SCALE), 1.0)
            w = leader(slot)
            g = (1 / (1 + np.exp(-np.clip(w @ value, -35, 35))) - y) * value
            squared = g * g
            z[slot] += g - (np.sqrt(n[slot] + squared) - np.sqrt(n[slot])) / alpha * w
            n[slot] += squared
    return leader(np.arange(DIM + 1))


def _numbers(column: pa.Array, kind: str) -> list[np.ndarray]:
    """The numbers in each cell of a binary column, as views of the column's own memory."""
    if not len(column):
        return []
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1].tolist()
    return [np.frombuffer(data, kind, (b - a) // 4, a) if b > a else np.zeros(0, kind) for a, b in zip(at[:-1], at[1:], strict=True)]


def learn(batches: Iterable[pa.RecordBatch]) -> np.ndarray | None:
    """``ftrl`` over batches of ``sparse_rows``, which are held once, as they came; None without rows."""
    rows = []
    for batch in batches:
        y, slots, values = (batch.column(batch.schema.get_field_index(c)) for c in ("y", "slots", "values"))
        rows += zip(y.to_pylist(), _numbers(slots, "<i4"), _numbers(values, "<f4"), strict=True)
    return ftrl(rows) if rows else None


def train(sample: DataFrame) -> np.ndarray:
    """Weights learned from the bounded sample (doc_id, text, y): features in parallel, updates in one task, in id-hash order.

    An empty sample gives a model that rejects nothing.
    """

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = learn(batches)
        if found is not None:
            yield pa.RecordBatch.from_arrays([pa.array([found.astype("<f4").tobytes()], pa.binary())], ["weights"])

    rows = sparse_rows(sample).repartition(1).sortWithinPartitions(F.xxhash64("doc_id"))
    found = rows.mapInArrow(fit, "weights binary").collect()  # one row of 1 MB, whatever the corpus
    if not found:
        return np.append(np.zeros(DIM, np.float32), np.float32(35))
    return np.frombuffer(found[0][0], "<f4").copy()


def score(documents: DataFrame, weights: np.ndarray) -> DataFrame:
    """``documents`` with a column ``score``: the logistic of the sparse dot product, 0 to 1, for empty and null texts too."""
    model = documents.sparkSession.sparkContext.broadcast(weights)  # DIM + 1 floats
    schema = documents.select("*", F.lit(0.0).alias("score")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = model.value.astype(np.float64)
        for batch in batches:
            for part in slices(batch):
                slot, doc, n = ngram_features(part.column(part.schema.get_field_index("text")))
                total = np.bincount(doc, weights=w[slot].sum(axis=1), minlength=part.num_rows) / np.maximum(n, 1)
                value = 1 / (1 + np.exp(-np.clip(total * SCALE + w[DIM], -35, 35)))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(value)], [f.name for f in schema])

    return documents.mapInArrow(run, schema)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def classify(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, max_train: int = MAX_TRAIN) -> DataFrame:
    """``documents`` with ``held_out``, ``score`` and ``predicted`` (1 if the score reaches ``threshold``).

    Rows stay as they are, repeated ones and null ids included; null and empty texts get the score of no evidence.
    Only ids outside the held-out quarter are learned from, ``max_train`` of them at most.  Columns named like the
    three added ones are replaced.
    """
    documents = documents.drop("score", "held_out", "predicted")
    weights = train(labelled_sample(documents, labels, "quality", ~held_out(F.col("doc_id")), max_train))
    return (
        score(documents, weights)
        .withColumn("held_out", held_out(F.col("doc_id")))
        .withColumn("predicted", (F.col("score") >= threshold).cast("int"))
    )
