"""Maximal periodic runs of words, by descending-LCP Kruskal over suffix classes.

Suffixes of a text are sorted by prefix doubling; neighbours in that order are edges weighted by the words they share.
Edges are taken in falling weight, and union-find joins the classes of suffixes at their ends; each class keeps its start
positions in order.  Whenever a union makes two positions i < j neighbours in a class and j - i is at most the edge's
weight w, words i .. j + w - 1 repeat with period j - i; the pair that can't be moved left seeds the run.  Such neighbours
have no smaller period: its multiple would lie between them.

A run has at least ``LEAST`` words and two periods, so its two copies share at least ``LEAST / 2`` words: classes of shorter
prefixes seed nothing, and their suffixes drop out before any union.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tapewell.llm.words import slices, words_of

LEAST = 12


def _classes(word: np.ndarray, doc: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffixes that share a word with another one of their text, sorted; and per power k of two the ranks by 2**k words.

    Equal ranks mean equal words: a suffix that ends within the words compared is unlike all others of its text.  Only
    classes of several suffixes are refined.
    """
    n = len(word)
    order = np.lexsort((word, doc))
    new = np.ones(n, bool)
    new[1:] = (word[order][1:] != word[order][:-1]) | (doc[order][1:] != doc[order][:-1])
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    ranks = [rank.astype(np.int32)]
    single = new & np.append(new[1:], True)
    live = order[~single]  # by rank
    reach = 1
    while len(live):
        at = live + reach
        after = np.where(at < end[live], rank[np.minimum(at, n - 1)] + 1, 0)
        sub = np.lexsort((after, rank[live]))
        live, after = live[sub], after[sub]
        head = rank[live]
        new = np.ones(len(live), bool)
        new[1:] = (head[1:] != head[:-1]) | (after[1:] != after[:-1])
        first = np.ones(len(live), bool)
        first[1:] = head[1:] != head[:-1]
        spot = np.arange(len(live))
        inside = spot - np.maximum.accumulate(np.where(first, spot, 0))
        lead = np.maximum.accumulate(np.where(new, spot, 0))
        order[head + inside] = live
        rank = rank.copy()
        rank[live] = (head + inside)[lead]
        ranks.append(rank.astype(np.int32))
        single = new & np.append(new[1:], True)
        live = live[~single]
        reach *= 2
    return order, ranks


def _shared(left: np.ndarray, right: np.ndarray, end: np.ndarray, ranks: list[np.ndarray]) -> np.ndarray:
    """How many words the suffixes of each pair, of one text, share."""
    out = np.zeros(len(left), np.int64)
    n = len(end)
    for k in range(len(ranks) - 1, -1, -1):
        a, b = left + out, right + out
        inside = (a < end[left]) & (b < end[right])
        same = inside & (ranks[k][np.minimum(a, n - 1)] == ranks[k][np.minimum(b, n - 1)])
        out += same.astype(np.int64) << k
    return out


def _join(large: list[int], sets: list[list[int]]) -> tuple[list[int], list[tuple[int, int]]]:
    """All ordered sets as one, and its neighbours that come from different sets."""
    if len(sets) == 1 and len(sets[0]) == 1:
        p = sets[0][0]
        k = bisect_left(large, p)
        large.insert(k, p)
        return large, [(large[m], large[m + 1]) for m in (k - 1, k) if 0 <= m < len(large) - 1]
    owner = {p: k for k, s in enumerate(sets) for p in s}
    if len(owner) * 16 < len(large):
        for p in owner:
            insort(large, p)
        at = {m for k in (bisect_left(large, p) for p in owner) for m in (k - 1, k) if 0 <= m < len(large) - 1}
    else:
        large = sorted([*large, *(p for s in sets for p in s)])  # ordered stretches: about one pass
        at = range(len(large) - 1)
    return large, [(large[m], large[m + 1]) for m in at if owner.get(large[m]) != owner.get(large[m + 1])]


def _seeds(order: np.ndarray, edge: np.ndarray, weight: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(i, j, w): newly neighbouring positions with j - i <= w.  Edge e ties the suffixes ``order[e]`` and ``order[e + 1]``.

    Edges of one weight that chain up are joined in one union, smaller sets into the largest, so that many equal suffixes
    cost one ordering.
    """
    root: dict[int, int] = {}
    held: dict[int, list[int]] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    def members(x: int) -> list[int]:
        return held.pop(x) if x in held else [int(order[x])]

    taken = np.lexsort((edge, -weight))
    edges, weights = edge[taken].tolist(), weight[taken].tolist()
    k = 0
    while k < len(edges):
        w = weights[k]
        chain = [find(edges[k])]
        while True:  # the class on the right of one edge may be on the left of the next
            right = find(edges[k] + 1)
            chain.append(right)
            k += 1
            if k == len(edges) or weights[k] != w or find(edges[k]) != right:
                break
        sets = sorted((members(c) for c in chain), key=len)
        joined, pairs = _join(sets[-1], sets[:-1])
        top = chain[0]
        for c in chain[1:]:
            root[c] = top
        held[top] = joined
        for i, j in pairs:
            if j - i <= w:
                yield i, j, w


def _runs(word: np.ndarray, doc: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, lengths and periods of all runs, by start and period; positions count through all texts."""
    none = np.zeros(0, np.int64)
    if len(word) < LEAST:
        return none, none, none
    end = first[doc + 1]
    order, ranks = _classes(word, doc, end)
    # Only neighbours that agree on LEAST / 2 words need their exact count: 4 words by rank, then the others.
    left, right = order[:-1], order[1:]
    k = min(2, len(ranks) - 1)
    edge = np.flatnonzero((ranks[k][left] == ranks[k][right]) & (doc[left] == doc[right]))
    weight = _shared(left[edge], right[edge], end, ranks)
    edge, weight = edge[2 * weight >= LEAST], weight[2 * weight >= LEAST]
    found = {(i, j - i + w, j - i) for i, j, w in _seeds(order, edge, weight)
             if j - i + w >= LEAST and (i == first[doc[i]] or word[i - 1] != word[j - 1])}
    if not found:
        return none, none, none
    out = np.array(sorted(found, key=lambda r: (r[0], r[2])), np.int64)
    return out[:, 0], out[:, 1], out[:, 2]


def _joined(data: np.ndarray, start: np.ndarray, end: np.ndarray, counts: np.ndarray) -> list[str]:
    """Words (spans of ``data``) joined by one space; ``counts`` words to each text."""
    length = end - start + 1
    begin = np.cumsum(length) - length
    source = np.arange(int(length.sum())) + np.repeat(start - begin, length)
    joined = np.append(data, np.uint8(32))[source]
    joined[begin + length - 1] = 32
    edge = np.append(begin, len(joined))[np.append(0, np.cumsum(counts))]
    raw = joined.tobytes()
    return [raw[a : max(a, b - 1)].decode() for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]


def _collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            words = words_of(part.column(1))
            n = len(words.key)
            word = np.unique(words.key, return_inverse=True)[1].astype(np.int64)
            start, length, period = _runs(word, words.doc, words.first)
            cover = np.zeros(n + 1, np.int64)
            np.add.at(cover, start + period, 1)
            np.add.at(cover, start + length, -1)
            stays = np.cumsum(cover[:n]) == 0
            total = np.append(0, np.cumsum(stays))
            kept = total[words.first[1:]] - total[words.first[:-1]]
            texts = _joined(words.data, words.start[stays], words.end[stays], kept)
            owner = words.doc[start]
            bounds = np.searchsorted(owner, np.arange(part.num_rows + 1)).astype(np.int32)
            fields = [pa.array(start - words.first[owner]), pa.array(length), pa.array(period)]
            runs = pa.ListArray.from_arrays(pa.array(bounds), pa.StructArray.from_arrays(fields, ["start", "length", "period"]))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(words.counts), runs, pa.array(texts, pa.string())], ["doc_id", "n_words", "runs", "collapsed"])


def runs(documents: DataFrame) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) of every row of ``documents`` (doc_id, text, ...).

    ``runs`` lists (start, length, period) of all maximal runs by start, then period: consecutive words of smallest period
    ``period``, at least 12 and two periods long, that no neighbouring word extends.  ``collapsed`` joins the words that no
    run contains behind its first period, by one space.  Null, empty and short texts have no runs; repeated rows, null ids
    and ids that repeat are rows of their own; other columns are ignored.  Each text is judged alone: nothing is shuffled.
    """
    given = documents.selectExpr("cast(doc_id as long) as doc_id", "text")
    return given.mapInArrow(_collapse, "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")
