"""Substring dedup with compressed FM-indexes.

Every window of 20 words has an anchor, the smallest hash among its 6-word runs, so equal windows have equal anchors
wherever they stand.  Consecutive windows with one anchor make a segment.  Segments whose anchor stands in one place
only can't repeat and are left out; the others go to the shard of their anchor, which keeps all equal windows
together.  A shard's segments, in document order, form the text of one FM-index: word symbols of 8 bits, their
Burrows-Wheeler transform in a bit-packed wavelet matrix.  The segments then stream through the index from right to
left by backward search; a match is cut to 20 words by going to its parent interval, so each step yields the matching
statistics of one more window.  Windows in an interval with several rows are compared by their 64-bit window hashes,
and all but the first place are reported.

Anchors with more than ``HOT`` places would make a shard as large as the group.  Their windows travel one by one, by
their own hash, and each batch sends a repeated window once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewell.llm.words import U, Words, grams, mix, slices, words_of
from tapewell.session import checkpointed

WINDOW = 20
ANCHOR = 6
HOT = 4096
SPREAD = 64
SHARD_SEGMENTS = 24_000  # about 600,000 words in an index
LAST = (1 << 63) - 1


class WaveletMatrix:
    """Rank over symbols of 8 bits: eight bit vectors, 64 bits to a word, with a running count per word."""

    def __init__(self, symbols: np.ndarray) -> None:
        self.levels = []
        self.begin = np.zeros(256, np.int64)  # where each symbol's block starts after the last level
        value = symbols.astype(np.uint8)
        at = np.zeros(256, np.int64)
        every = np.arange(256)
        for bit in range(7, -1, -1):
            b = (value >> bit) & 1
            bits = np.packbits(b, bitorder="little")
            padded = np.zeros((len(b) // 64 + 1) * 8, np.uint8)
            padded[: len(bits)] = bits
            words = padded.view(U)
            counts = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])
            zeros = len(b) - int(counts[-1])
            level = (words, counts, zeros)
            self.levels.append(level)
            at = self._down(level, at, ((every >> bit) & 1).astype(bool))
            value = np.concatenate([value[b == 0], value[b == 1]])
        self.begin = at

    @staticmethod
    def _down(level: tuple, at: np.ndarray, one: np.ndarray) -> np.ndarray:
        words, counts, zeros = level
        word = at >> 6
        ones = counts[word] + np.bitwise_count(words[word] & ((U(1) << (at & 63).astype(U)) - U(1)))
        return np.where(one, zeros + ones, at - ones)

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each place."""
        for k, level in enumerate(self.levels):
            at = self._down(level, at, ((symbol >> (7 - k)) & 1).astype(bool))
        return at - self.begin[symbol]


class FMIndex:
    """Index of a text of symbols 1..255 with 0 between its parts; suffixes in order of their first ``WINDOW`` symbols."""

    def __init__(self, text: np.ndarray) -> None:
        text = np.append(text, np.uint8(0))
        n = len(text)
        padded = np.concatenate([text, np.zeros(WINDOW + 8, np.uint8)])
        eight = np.zeros(n + WINDOW, U)
        for k in range(8):
            eight = eight << U(8) | padded[k : k + n + WINDOW].astype(U)
        r8 = np.unique(eight, return_inverse=True)[1].astype(np.int64)
        r16 = np.unique(r8[:n] * (n + WINDOW) + r8[8 : n + 8], return_inverse=True)[1].astype(np.int64)
        four = (eight[16 : n + 16] >> U(32)).astype(np.int64)
        self.order = np.argsort(r16 << 32 | four, kind="stable")
        left, right = self.order[:-1], self.order[1:]
        new = np.ones(n, bool)
        new[1:] = (r16[left] != r16[right]) | (four[left] >> 8 != four[right] >> 8)
        self.parent = np.append(np.flatnonzero(new), n)  # intervals of one symbol less than a window
        self.parent_of = np.cumsum(new) - 1
        before = text[self.order - 1]
        before[self.order == 0] = 0
        self.bwt = WaveletMatrix(before)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=256))])[:256]
        self.size = n

    def extend(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search: the interval of each match with one more symbol on its left."""
        symbol = symbol.astype(np.int64)
        return self.first[symbol] + self.bwt.rank(symbol, lo), self.first[symbol] + self.bwt.rank(symbol, hi)

    def windows(self, text: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Stream parts ``text[begin:end]`` side by side; for every place of ``text`` the interval of the window that
        starts there (empty where there is none).  The parts need not be in the index."""
        low, high = np.zeros(len(text), np.int64), np.zeros(len(text), np.int64)
        lane = np.argsort(begin - end, kind="stable")
        begin, end = begin[lane], end[lane]
        lo, hi = np.zeros(len(lane), np.int64), np.full(len(lane), self.size)
        length = np.zeros(len(lane), np.int64)
        size = end - begin
        for k in range(int(size[0]) if len(size) else 0):
            m = int(np.searchsorted(-size, -k, "left"))  # parts longer than k symbols
            if k >= WINDOW:
                full = np.flatnonzero((length[:m] == WINDOW) & (hi[:m] > lo[:m]))
                group = self.parent_of[lo[full]]
                lo[full], hi[full] = self.parent[group], self.parent[group + 1]
                length[full] -= 1
            at = end[:m] - 1 - k
            lo[:m], hi[:m] = self.extend(text[at], lo[:m], hi[:m])
            length[:m] += 1
            lost = np.flatnonzero(hi[:m] <= lo[:m])
            for i in lost:  # a text that isn't indexed: look for the longest match that starts here
                lo[i], hi[i], length[i] = self._longest(text, int(at[i]), int(min(end[i], at[i] + WINDOW)))
            done = np.flatnonzero((length[:m] == WINDOW))
            low[at[done]], high[at[done]] = lo[done], hi[done]
        return low, high

    def _longest(self, text: np.ndarray, at: int, end: int) -> tuple[int, int, int]:
        one = np.zeros(1, np.int64)
        for stop in range(end, at, -1):
            lo, hi = one, one + self.size
            for j in range(stop - 1, at - 1, -1):
                lo, hi = self.extend(text[j : j + 1], lo, hi)
                if hi[0] <= lo[0]:
                    break
            if hi[0] > lo[0]:
                return int(lo[0]), int(hi[0]), stop - at
        return 0, self.size, 0


def _segments(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First windows (by word number), window counts and anchors of all segments, and the hashes of all windows."""
    run, _ = np.zeros(0, U), None
    full, at = grams(words, WINDOW)
    wide = np.zeros(len(words.key), U)
    wide[at] = full
    if not len(at):
        return at, at, run, wide
    small, where = grams(words, ANCHOR)
    value = np.full(len(words.key), ~U(0))
    value[where] = small
    best = at.copy()
    least = value[at]
    for k in range(1, WINDOW - ANCHOR + 1):
        own = value[at + k]
        better = own < least
        least = np.where(better, own, least)
        best = np.where(better, at + k, best)
    new = np.ones(len(at), bool)
    new[1:] = (best[1:] != best[:-1]) | (at[1:] != at[:-1] + 1)
    start = np.flatnonzero(new)
    return at[start], np.diff(np.append(start, len(at))), least[start], wide


def _anchors(texts: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                words = words_of(part.column(1))
                first, count, anchor, _ = _segments(words)
                doc = words.doc[first]
                place = (first - words.first[doc]) << 4 | count  # at most 15 windows share an anchor
                yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(np.asarray(part.column(0))[doc]), pa.array(place)], ["anchor", "id", "place"])

    return texts.mapInArrow(run, "anchor long, id long, place long")


_PIECES = pa.schema([("unit", pa.int64()), ("id", pa.int64()), ("start", pa.int64()), ("known", pa.bool_()), ("symbols", pa.binary()), ("hashes", pa.binary())])


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, text, places) -> the marked segments with their symbols and window hashes."""
    for batch in batches:
        for part in slices(batch):
            words = words_of(part.column(1))
            first, count, anchor, wide = _segments(words)
            ids, marks = np.asarray(part.column(0)), part.column(2)
            symbol = (words.key % U(255) + U(1)).astype(np.uint8)
            doc = words.doc[first]
            place = (first - words.first[doc]) << 4 | count
            marked = marks.flatten().to_numpy(zero_copy_only=False)
            owner = np.repeat(np.arange(len(ids)), np.diff(marks.offsets.to_numpy()))
            # place is below 2^40 and a slice holds fewer than 2^22 texts
            own, want = doc << 40 | place, owner << 40 | (marked >> 1)
            order = np.argsort(want)
            want, hot = want[order], (marked & 1)[order]
            at = np.minimum(np.searchsorted(want, own), max(len(want) - 1, 0))
            hit = want[at] == own if len(want) else np.zeros(len(own), bool)
            warm = hit & (hot[at] == 0) if len(want) else hit
            rows = [(int(a), int(ids[d]), int(f - words.first[d]), False, symbol[f : f + n + WINDOW - 1].tobytes(), wide[f : f + n].tobytes())
                    for a, d, f, n in zip(anchor[warm].view(np.int64), doc[warm], first[warm], count[warm], strict=True)]
            single = np.flatnonzero(hit & ~warm)
            if len(single):
                windows = np.concatenate([np.arange(first[i], first[i] + count[i]) for i in single])
                rank = np.lexsort((windows - words.first[words.doc[windows]], ids[words.doc[windows]], wide[windows]))
                windows = windows[rank]
                d, s = ids[words.doc[windows]], windows - words.first[words.doc[windows]]
                h = wide[windows]
                lead = np.ones(len(h), bool)
                lead[1:] = h[1:] != h[:-1]
                head = np.maximum.accumulate(np.where(lead, np.arange(len(h)), 0))
                known = (d != d[head]) | (s != s[head])
                spread = mix(d.astype(U) + s.astype(U) * U(0x9E3779B97F4A7C15)).view(np.int64)  # what is known needs no index
                rows += [(int(z if y else k), int(i), int(x), bool(y), b"" if y else symbol[f : f + WINDOW].tobytes(), k.tobytes())
                         for k, z, i, x, y, f in zip(h.view(np.int64), spread, d, s, known, windows, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), _PIECES, strict=True)] if rows else [pa.array([], t.type) for t in _PIECES], schema=_PIECES)


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One shard: index its segments, stream them through, report (id, start, hash) of windows that stood earlier."""
    out = lambda i, s, h: pa.RecordBatch.from_arrays([pa.array(i), pa.array(s), pa.array(h.view(np.int64))], ["id", "start", "hash"])
    kept = []
    for batch in batches:
        table = pa.Table.from_batches([batch])
        known = batch.column(3).to_numpy(zero_copy_only=False)
        if known.any():
            done = table.filter(pa.array(known)).combine_chunks()
            yield out(done["id"].to_numpy(), done["start"].to_numpy(), np.frombuffer(b"".join(done["hashes"].to_pylist()), U))
        kept.append(table.filter(pa.array(~known)))
    table = pa.concat_tables(kept).combine_chunks() if kept else None
    if table is None or not table.num_rows:
        return
    ids, starts = table["id"].to_numpy(), table["start"].to_numpy()
    symbols, hashes = table["symbols"].to_pylist(), table["hashes"].to_pylist()
    order = np.lexsort((starts, ids))
    ids, starts = ids[order], starts[order]
    text = np.frombuffer(b"\0".join([symbols[i] for i in order]), np.uint8)
    size = np.array([len(symbols[i]) for i in order])
    begin = np.cumsum(size + 1) - size - 1
    low, high = FMIndex(text).windows(text, begin, begin + size)
    wins = size - WINDOW + 1
    lane = np.repeat(np.arange(len(size)), wins)
    inner = np.arange(len(lane)) - np.repeat(np.cumsum(wins) - wins, wins)
    place = begin[lane] + inner
    h = np.frombuffer(b"".join([hashes[i] for i in order]), U)
    low, several = low[place], (high - low)[place] > 1
    lane, inner, low, h = lane[several], inner[several], low[several], h[several]
    rank = np.lexsort((h, low))  # stable: the first of equals stands first in document order
    lane, inner, low, h = lane[rank], inner[rank], low[rank], h[rank]
    if not len(h):
        return
    lead = np.ones(len(h), bool)
    lead[1:] = (low[1:] != low[:-1]) | (h[1:] != h[:-1])
    head = np.maximum.accumulate(np.where(lead, np.arange(len(h)), 0))
    i, s = ids[lane], starts[lane] + inner
    later = (i != i[head]) | (s != s[head])
    yield out(i[later], s[later], h[later])


def repeats(documents: DataFrame) -> DataFrame:
    """(id, start, hash): windows of 20 words that start at word ``start`` of ``id`` and stood earlier already.

    ``id`` is the doc_id; null ids count as one document behind all others.
    """
    texts = _texts(documents)
    marks = checkpointed(_marks(checkpointed(_anchors(texts))))
    shards = max(documents.sparkSession.sparkContext.defaultParallelism, -(-marks.count() // SHARD_SEGMENTS))
    places = marks.distinct().groupBy("id").agg(F.collect_list("mark").alias("places"))  # no more than a text has windows
    pieces = texts.join(places, "id").select("id", "text", "places").mapInArrow(_pieces, "unit long, id long, start long, known boolean, symbols binary, hashes binary")
    return pieces.repartition(shards, "unit").mapInArrow(_search, "id long, start long, hash long")


def _marks(places: DataFrame) -> DataFrame:
    """(id, mark) of the places whose anchor stands in more than one; the lowest bit of a mark tells a hot anchor.

    Places are counted in partial sums.  They look for hot anchors in ``SPREAD`` parts; then only those of other anchors,
    at most ``HOT`` of one, meet at their count, so that no task sees all places of a hot anchor.
    """
    counts = checkpointed(places.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1"))
    hot = checkpointed(counts.where(F.col("n") > HOT).select("anchor", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))).alias("part")))
    placed = places.withColumn("part", F.pmod(F.xxhash64("id", "place"), F.lit(SPREAD)).cast("int"))
    placed = placed.join(hot.withColumn("hot", F.lit(1)), ["anchor", "part"], "left")
    own = F.when(F.col("hot").isNull(), F.col("anchor")).otherwise(F.xxhash64("id", "place"))  # a hot anchor needs no count
    few = counts.where(F.col("n") <= HOT).select(F.col("anchor").alias("own"), "n")
    known = placed.withColumn("own", own).join(few, "own", "left").where("hot is not null or n is not null")
    return known.select("id", (F.shiftleft("place", 1) + F.coalesce("hot", F.lit(0))).alias("mark"))


def _texts(documents: DataFrame) -> DataFrame:
    return documents.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("id"), F.coalesce("text", F.lit("")).alias("text"))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, text, windows) -> id, n_words, n_removed and the kept words, joined by one space."""
    for batch in batches:
        for part in slices(batch):
            words = words_of(part.column(1))
            n = len(words.key)
            full, at = grams(words, WINDOW)
            wide = np.zeros(n + 1, U)
            wide[at] = full
            cover = np.zeros(n + WINDOW + 1, np.int64)
            lists = part.column(2)
            counts = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten()
            start, h = flat.field("start").to_numpy(), flat.field("hash").to_numpy().view(U)
            row = np.repeat(np.arange(part.num_rows), counts)
            place = words.first[row] + start
            good = place + WINDOW <= words.first[row + 1]  # a repeated id may have another text
            place, h = place[good], h[good]
            place = np.unique(place[wide[place] == h])
            np.add.at(cover, place, 1)
            np.add.at(cover, place + WINDOW, -1)
            stays = np.cumsum(cover[:n]) == 0
            total = np.concatenate([[0], np.cumsum(stays)])
            kept = total[words.first[1:]] - total[words.first[:-1]]
            length = (words.end - words.start + 1)[stays]
            begin = np.cumsum(length) - length
            source = np.arange(int(length.sum())) + np.repeat(words.start[stays] - begin, length)
            joined = np.append(words.data, np.uint8(32))[source]
            joined[begin + length - 1] = 32
            edge = np.append(begin, len(joined))[np.concatenate([[0], np.cumsum(kept)])]
            raw = joined.tobytes()
            texts = [raw[a : max(a, b - 1)].decode() for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(words.counts), pa.array(words.counts - kept), pa.array(texts, pa.string())], ["id", "n_words", "n_removed", "kept"])


def dedup(documents: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept) of every row of ``documents`` (doc_id, text, ...).

    A word goes if a window of 20 consecutive words that covers it also starts earlier: in a document of smaller id, or
    earlier in the same one.  Null and empty texts have no words and keep the empty text.  Null ids count as one document
    behind all others; rows that share an id are places of one document, so exactly repeated rows don't remove each
    other.  Other columns are ignored.
    """
    found = repeats(documents).groupBy("id").agg(F.collect_list(F.struct("start", "hash")).alias("windows"))
    none = F.array().cast("array<struct<start:bigint,hash:bigint>>")
    joined = _texts(documents).join(found, "id", "left").select("id", "text", F.coalesce("windows", none).alias("windows"))
    out = joined.mapInArrow(_cut, "id long, n_words long, n_removed long, kept string")
    return out.select(F.when(F.col("id") != LAST, F.col("id")).alias("doc_id"), "n_words", "n_removed", "kept")
