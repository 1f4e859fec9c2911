"""Benchmark decontamination: a BM25 index of the test items, searched with block-max WAND by every training passage.

Impacts are BM25 weights divided by the item's own total, so a passage with all of an item's terms scores 1 and one
threshold holds for items of any length.  Items come in indexes of ``INDEX_ITEMS``, broadcast in groups of at most
``GROUP_BYTES`` of text, so what is broadcast doesn't depend on the benchmark or the corpus; every document meets every
index.  For each block of a few items an index holds the largest impact of every term; a passage whose terms can't reach
the threshold in any block is done with, and WAND goes through the postings of the others.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapewell.llm.features import _CLASS
from tapewell.llm.words import LOWER, U, Words, bytes_of, grams, hash_spans, slices, spans_of

K1, B = 1.2, 0.75
THRESHOLD = 0.5
OVERLAP = 0.5
SHINGLE = 5
POSTINGS = 32  # to a block of a list with its own maximum
BLOCK_ITEMS = 4
INDEX_ITEMS = 512
GROUP_BYTES = 8_000_000
_BUCKETS = 22


def terms_of(column: pa.Array) -> Words:
    """Runs of letters and digits, A-Z lower-cased; signs and spaces only separate them."""
    data, offsets = bytes_of(column)
    start, end, doc = spans_of((_CLASS[data] == 1).view(np.uint8), offsets)
    return Words(data, start, end, doc, np.searchsorted(doc, np.arange(len(offsets))), hash_spans(LOWER[data], start, end))


def split_item(text: str) -> tuple[str, str]:
    """Question and answer: the last line of several, else the last of several sentences, is the answer."""
    text = text.strip()
    cut = text.rfind("\n")
    if cut < 0:
        ends = [m.end() for m in re.finditer(r"[.?!]\s+", text)]
        cut = ends[-1] if ends else len(text)
    return text[:cut], text[cut:]


def run_lengths(question: int, answer: int) -> tuple[int, int]:
    """Words to a run of a question and an answer with so many words.

    A changed word breaks as many runs as a run has words, so the runs of a short answer are as long as one changed word
    leaves half of them: one word up to four, two words up to seven, five from fourteen on.  Questions keep runs of five,
    which tie the answer's words to the item.
    """
    return min(SHINGLE, question), min(SHINGLE, answer, max(1, (answer + 1) // 3))


def _runs(text: str, length: int) -> np.ndarray:
    return np.unique(grams(terms_of(pa.array([text])), max(1, length))[0])


@dataclass
class Index:
    ids: list
    terms: np.ndarray  # sorted hashes
    most: np.ndarray  # the largest impact of each term
    block: np.ndarray  # and that in each block of items
    lists: list  # per term: items, impacts, block maxima
    parts: list  # per item: (run length, runs) of question and answer
    longest: int
    bucket: np.ndarray


def build(items: list[tuple]) -> Index:
    texts = [t or "" for _, t in items]
    w = terms_of(pa.array(texts, pa.string()))
    terms, place = np.unique(w.key, return_inverse=True)
    cell, tf = np.unique(w.doc * max(len(terms), 1) + place, return_counts=True)
    item, term = cell // max(len(terms), 1), cell % max(len(terms), 1)
    length = w.counts
    df = np.bincount(term, minlength=len(terms))
    idf = np.log(1 + (len(items) - df + 0.5) / (df + 0.5))
    impact = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[item] / max(length.mean(), 1))) if len(items) else np.zeros(0)
    impact /= np.maximum(np.bincount(item, weights=impact, minlength=len(items)), 1e-12)[item]
    most = np.zeros(len(terms))
    np.maximum.at(most, term, impact)
    block = np.zeros((len(terms), -(-len(items) // BLOCK_ITEMS)), np.float32)
    np.maximum.at(block, (term, item // BLOCK_ITEMS), impact * (1 + 1e-6))
    order = np.lexsort((item, term))
    bounds = np.searchsorted(term[order], np.arange(len(terms) + 1))
    lists = []
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        own = impact[order[a:b]]
        lists.append((item[order[a:b]].tolist(), own.tolist(), [float(own[k : k + POSTINGS].max()) for k in range(0, b - a, POSTINGS)]))
    parts = []
    for t in texts:
        both = split_item(t)
        lengths = run_lengths(*[len(terms_of(pa.array([part])).key) for part in both])
        parts.append([(n, _runs(part, n)) for n, part in zip(lengths, both, strict=True)])
    bucket = np.zeros(1 << _BUCKETS, bool)
    bucket[(terms >> U(64 - _BUCKETS)).astype(np.int64)] = True
    return Index([i for i, _ in items], terms, most, block, lists, parts, int(length.max(initial=0)), bucket)


def search(index: Index, terms: list[int], threshold: float) -> list[tuple[int, float]]:
    """All items whose impacts over the distinct ``terms`` reach ``threshold``, by block-max WAND."""
    cursors = [[*index.lists[t], float(index.most[t]), 0] for t in terms]
    found = []
    end = len(index.ids)
    while cursors:
        cursors.sort(key=lambda c: c[0][c[4]])
        bound, pivot = 0.0, -1
        for k, c in enumerate(cursors):
            bound += c[3]
            if bound >= threshold:
                pivot = k
                break
        if pivot < 0:
            break
        item = cursors[pivot][0][cursors[pivot][4]]
        while pivot + 1 < len(cursors) and cursors[pivot + 1][0][cursors[pivot + 1][4]] == item:
            pivot += 1
        bound, after = 0.0, end
        for c in cursors[: pivot + 1]:
            at = bisect_left(c[0], item, c[4])
            if at < len(c[0]):
                bound += c[2][at // POSTINGS]
                last = min(len(c[0]), (at // POSTINGS + 1) * POSTINGS) - 1
                after = min(after, c[0][last] + 1)
        if bound < threshold:  # no item up to the end of these blocks can reach it
            if pivot + 1 < len(cursors):
                after = min(after, cursors[pivot + 1][0][cursors[pivot + 1][4]])
            target = max(after, item + 1)
        else:
            total = 0.0
            for c in cursors[: pivot + 1]:
                at = bisect_left(c[0], item, c[4])
                if at < len(c[0]) and c[0][at] == item:
                    total += c[1][at]
            if total >= threshold:
                found.append((item, total))
            target = item + 1
        for c in cursors[: pivot + 1]:
            c[4] = bisect_left(c[0], target, c[4])
        cursors = [c for c in cursors if c[4] < len(c[0])]
    return found


def leaks_in(column: pa.Array, group: list[Index], threshold: float, overlap: float) -> list[tuple]:
    """(text number, item id, score, question overlap, answer overlap) of all verified pairs of a slice of texts."""
    words = terms_of(column)
    return [row for index in group if len(index.terms) for row in _leaks_of(words, index, threshold, overlap)]


def _leaks_of(words: Words, index: Index, threshold: float, overlap: float) -> list[tuple]:
    known = index.bucket[(words.key >> U(64 - _BUCKETS)).astype(np.int64)]
    at = np.flatnonzero(known)
    term = np.minimum(np.searchsorted(index.terms, words.key[at]), len(index.terms) - 1)
    hit = index.terms[term] == words.key[at]
    at, term = at[hit], term[hit]
    # Passages of two strides of words: any run as long as the longest item lies whole in one of them.
    stride = max(64, index.longest)
    number = (at - words.first[words.doc[at]]) // stride
    base = np.concatenate([[0], np.cumsum(words.counts // stride + 2)])
    own = base[words.doc[at]] + number
    n = len(index.terms)
    cell = np.unique(np.concatenate([own, own + 1]) * n + np.concatenate([term, term]))
    passage, term = cell // n, cell % n
    # Without a block whose maxima reach the threshold, WAND has no pivot to stop at.
    first = np.flatnonzero(np.diff(passage, prepend=-1))
    rich = np.zeros(len(first), bool)
    most = index.block.shape[1]
    for lo in range(0, len(first), step := max(1, 4_000_000 // (64 * most))):
        ends = np.append(first[lo : lo + step], first[lo + step] if lo + step < len(first) else len(passage))
        bounds = np.add.reduceat(index.block[term[ends[0] : ends[-1]]], ends[:-1] - ends[0], axis=0)
        rich[lo : lo + step] = bounds.max(axis=1) >= threshold * (1 - 1e-5)
    keep = np.repeat(rich, np.diff(np.append(first, len(passage))))
    passage, term = passage[keep], term[keep]
    best: dict[tuple[int, int], tuple] = {}
    bounds = np.append(np.flatnonzero(np.diff(passage, prepend=-1)), len(passage))
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        found = search(index, term[a:b].tolist(), threshold)
        if not found:
            continue
        doc = int(np.searchsorted(base, passage[a], "right") - 1)
        k = int(passage[a] - base[doc]) - 1
        lo = int(words.first[doc]) + max(0, k * stride)
        hi = min(int(words.first[doc + 1]), int(words.first[doc]) + (k + 2) * stride)
        part = Words(words.data, words.start[lo:hi], words.end[lo:hi], words.doc[lo:hi], words.first, words.key[lo:hi])
        seen = {m: grams(part, m)[0] for m in range(1, SHINGLE + 1)}
        for item, score in found:
            share = [float(np.isin(s, seen[m]).mean()) if len(s) else 1.0 for m, s in index.parts[item]]
            if min(share) >= overlap:
                row = (score, *share)
                if row > best.get((doc, item), ()):
                    best[doc, item] = row
    return [(d, index.ids[i], *row) for (d, i), row in best.items()]


def _indexes(benchmark: DataFrame) -> Iterator:
    """Broadcast groups of indexes, items in order."""
    rows = benchmark.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0))).first()[0]
    groups = max(1, -(-size // GROUP_BYTES))
    for k in range(groups):
        own = [tuple(r) for r in rows.where(F.pmod(F.xxhash64("item_id"), F.lit(groups)) == k).orderBy("item_id", "text").collect()]  # a group of bounded size
        yield benchmark.sparkSession.sparkContext.broadcast([build(own[a : a + INDEX_ITEMS]) for a in range(0, max(len(own), 1), INDEX_ITEMS)])


def leaks(documents: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP) -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap): documents with a passage that holds a test item.

    A pair is reported if the item's BM25 score by the passage reaches ``threshold`` of the item's own total and the
    passage has at least the share ``overlap`` of the runs of five words of its question and of the runs of its answer
    (``run_lengths``), so one changed word of an answer of two or more words doesn't hide an item.  Null and empty texts and items match nothing; rows with a null doc_id are searched and reported with it; repeated rows are
    reported each.  Other columns are ignored.
    """
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"

    def run(index):
        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch):
                    found = leaks_in(part.column(1), index.value, threshold, overlap)
                    docs = part.column(0).take(pa.array([f[0] for f in found], pa.int64()))
                    cols = [pa.array([f[1] for f in found], pa.int64()), *(pa.array([f[k] for f in found], pa.float64()) for k in (2, 3, 4))]
                    yield pa.RecordBatch.from_arrays([docs, *cols], ["doc_id", "item_id", "score", "question_overlap", "answer_overlap"])

        return rows

    out = None
    for index in _indexes(benchmark):
        part = texts.mapInArrow(run(index), schema)
        out = part if out is None else out.unionByName(part)
    return out


def clean(documents: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP) -> DataFrame:
    """The rows of ``documents`` without any test item, unchanged; rows with null or empty texts stay."""
    schema: T.StructType = documents.schema

    def run(index):
        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch):
                    bad = {f[0] for f in leaks_in(part.column(part.schema.get_field_index("text")), index.value, threshold, overlap)}
                    yield part.filter(pa.array([k not in bad for k in range(part.num_rows)]))

        return rows

    for index in _indexes(benchmark):
        documents = documents.mapInArrow(run(index), schema)
    return documents
