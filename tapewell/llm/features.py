"""Sparse hashed text features and the labelled sample that the classifiers learn from."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapewell.llm.words import LOWER, U, bytes_of, hash_spans, mix, slices, spans_of

BITS = 18
DIM = 1 << BITS

# Byte classes: 0 white space, 1 letters, digits and everything beyond ASCII, 2 other signs.
_CLASS = np.full(256, 2, np.uint8)
_CLASS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = 0
_CLASS[48:58] = _CLASS[65:91] = _CLASS[97:123] = _CLASS[128:] = 1
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True


def _index(h: np.ndarray) -> np.ndarray:
    return (h >> U(64 - BITS)).astype(np.int32)


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word and sign runs of every text: folded hash, shape (a small number or a sign run's hash), text number, bounds."""
    data, offsets = bytes_of(column)
    start, end, doc = spans_of(_CLASS[data], offsets)
    h = hash_spans(LOWER[data], start, end)
    if not len(start):
        return h, h, doc, np.zeros(len(offsets), np.int64)
    long = end - start > 1
    second = _UPPER[data[np.minimum(start + 1, len(data) - 1)]] & long
    shape = (U(1) + _UPPER[data[start]].astype(U) + U(2) * second.astype(U) + U(4) * long.astype(U)).astype(U)
    shape = np.where(_CLASS[data[start]] == 2, h, shape)
    return h, shape, doc, np.searchsorted(doc, np.arange(len(offsets)))


def ngram_features(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed n-grams of every text: slots, text numbers, tokens per text.

    Per token: its word, the word pair it ends, and the pair of shapes it ends (case, signs, and whether the
    word repeats the one before or the one before that).  Positions come from the text alone.
    """
    h, shape, doc, first = tokens(column)
    n = np.diff(first)
    before, two = np.roll(h, 1), np.roll(h, 2)
    inside, inside2 = np.zeros(len(h), bool), np.zeros(len(h), bool)
    inside[1:] = doc[1:] == doc[:-1]
    inside2[2:] = doc[2:] == doc[:-2]
    same = (inside & (before == h)).astype(U) + U(2) * (inside2 & (two == h)).astype(U)
    pair = mix(np.where(inside, before, U(7)) * U(0x9E3779B97F4A7C15) + h)
    form = mix(np.where(inside, np.roll(shape, 1), U(7)) * U(0xC2B2AE3D27D4EB4F) + shape * U(8) + same)
    slot = np.stack([_index(h), _index(pair), _index(form)], axis=1)
    return slot, doc, n


PREFIXES = (4, 5, 6, 7, 8)


def word_keys(column: pa.Array, known: np.ndarray | None = None, bits: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Different words of every text and their beginnings of 4 to 8 bytes, A-Z lower-cased: 64-bit hashes and text numbers.

    ``known`` marks, by their upper ``bits``, the only hashes of interest.
    """
    data, offsets = bytes_of(column)
    data = LOWER[data]
    start, end, doc = spans_of((_CLASS[data] == 1).view(np.uint8), offsets)
    hashes, owners = [], []
    for k in (None, *PREFIXES):
        some = slice(None) if k is None else np.flatnonzero(end - start > k)
        h = hash_spans(data, start[some], end[some] if k is None else start[some] + k)
        own = doc[some]
        if known is not None:
            use = known[(h >> U(64 - bits)).astype(np.int64)]
            h, own = h[use], own[use]
        hashes.append(h)
        owners.append(own)
    h, doc = np.concatenate(hashes), np.concatenate(owners)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[keep], doc[keep]


def labelled_sample(documents: DataFrame, labels: DataFrame, label: str, keep: Column, bound: int) -> DataFrame:
    """At most about ``bound`` labelled rows (doc_id, text, y), the ids with the smallest hashes.

    ``labels`` may name an id twice: its largest label counts; null ids and null labels don't.  Ids are thinned by a
    threshold on their hash before any text is read, so the sample's size doesn't depend on the corpus.
    """
    given = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & keep).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    total = given.count()
    if total > bound:
        given = given.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.lit(int(bound / total * (1 << 30))))
    # `bound` ids and labels of 16 bytes each: safe to broadcast at any corpus size.
    return documents.select("doc_id", "text").join(F.broadcast(given), "doc_id").select("doc_id", "text", "y")


def sparse_rows(sample: DataFrame) -> DataFrame:
    """(doc_id, y, slots, values): little-endian int32 slots and float32 shares of each sampled text's tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                ids, text, y = part.columns
                slot, doc, n = ngram_features(text)
                out_slots, out_values = [], []
                bounds = np.searchsorted(doc, np.arange(len(text) + 1))
                for d in range(len(text)):
                    own, count = np.unique(slot[bounds[d] : bounds[d + 1]], return_counts=True)
                    out_slots.append(own.astype("<i4").tobytes())
                    out_values.append((count / max(n[d], 1)).astype("<f4").tobytes())
                yield pa.RecordBatch.from_arrays([ids, y, pa.array(out_slots, pa.binary()), pa.array(out_values, pa.binary())], ["doc_id", "y", "slots", "values"])

    return sample.mapInArrow(run, "doc_id long, y int, slots binary, values binary")
