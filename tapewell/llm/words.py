"""Words of whole texts as arrays: starts, ends, owners and hashes for all texts of an Arrow batch at once.

Everything here works on the UTF-8 bytes of a batch with a fixed number of vector operations, so the cost per
word is some tens of nanoseconds, and memory is bounded by ``CHUNK`` bytes of text or the longest single text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 2_000_000
U = np.uint64

_BASE = U(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of unsigned 64-bit values; equal values stay equal, different ones different."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_POWERS = np.ones(1, U)


def _powers(n: int) -> np.ndarray:
    global _POWERS
    while len(_POWERS) < n:
        top = _POWERS[-1:] * _BASE
        _POWERS = np.concatenate([_POWERS, _POWERS * top])
    return _POWERS[:n]


@dataclass
class Words:
    """``data`` holds the bytes; word i is ``data[start[i]:end[i]]`` of text ``doc[i]``; ``first[d]`` is the first word of text d."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    first: np.ndarray
    key: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string column; null counts as the empty text."""
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def spans_of(kind: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of one non-zero kind within one text: starts, ends and text numbers."""
    n = len(kind)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut = np.ones(n + 1, bool)
    cut[1:n] = kind[1:] != kind[:-1]
    cut[offsets] = True
    at = np.flatnonzero(cut)
    start, end = at[:-1], at[1:]
    keep = kind[start] != 0
    start, end = start[keep], end[keep]
    return start, end, np.searchsorted(offsets, start, "right") - 1


def hash_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray, block: int = CHUNK) -> np.ndarray:
    """A 64-bit hash of each span, the same wherever the span stands.  Spans are disjoint and in order."""
    out = np.empty(len(start), U)
    i = 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(end, start[i] + block, "right")))
        lo, hi = int(start[i]), int(end[j - 1])
        size = (end[i:j] - start[i:j]).astype(np.int64)
        begin = np.cumsum(size) - size
        inside = np.arange(int(size.sum()), dtype=np.int64) - np.repeat(begin, size)
        value = data[lo:hi][inside + np.repeat(start[i:j] - lo, size)].astype(U) + U(1)
        value *= _powers(int(size.max()))[inside]
        out[i:j] = mix(np.add.reduceat(value, begin) + size.astype(U) * U(0xD6E8FEB86659FD93))
        i = j
    return out


def words_of(column: pa.Array, lower: bool = False) -> Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of every text; with ``lower`` A-Z count as a-z."""
    data, offsets = bytes_of(column)
    if lower:
        data = LOWER[data]
    start, end, doc = spans_of((~_SPACE[data]).view(np.uint8), offsets)
    first = np.searchsorted(doc, np.arange(len(offsets)))
    return Words(data, start, end, doc, first, hash_spans(data, start, end))


def slices(batch: pa.RecordBatch, text: str = "text", size: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of about ``size`` bytes of text, one row at least."""
    n = batch.num_rows
    if n == 0:
        return
    lengths = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0).to_numpy(zero_copy_only=False)
    total = np.cumsum(lengths)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + size, "right")))
        yield batch.slice(i, j - i)
        i = j


def grams(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``n`` consecutive words of one text, with the number of their first word."""
    m = len(words.key) - n + 1
    if m <= 0:
        return np.zeros(0, U), np.zeros(0, np.int64)
    h = np.zeros(m, U)
    for k in range(n):
        h = h * _BASE + words.key[k : k + m]
    at = np.flatnonzero(words.doc[:m] == words.doc[n - 1 :])
    return mix(h[at]), at


def shingle_sets(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of every text, sorted within the text, and the bounds of each text's share.

    A text with fewer than ``n`` words but at least one has its whole word sequence as its one shingle.
    """
    h, at = grams(words, n)
    doc = words.doc[at]
    short = np.flatnonzero((words.counts > 0) & (words.counts < n))
    if len(short):
        whole = []
        for d in short:
            acc = np.zeros(1, U)
            for k in range(words.first[d], words.first[d + 1]):
                acc = acc * _BASE + words.key[k]
            whole.append(acc)
        h, doc = np.concatenate([h, mix(np.concatenate(whole))]), np.concatenate([doc, short])
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[keep], doc[keep]
    return h, np.searchsorted(doc, np.arange(len(words.first)))
