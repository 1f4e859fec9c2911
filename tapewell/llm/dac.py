"""Token ids in files of directly addressable codes.

An id is cut into chunks of eight bits.  Level k of a file holds the k-th chunk of every id that has one, a bitmap that
tells which of them go on in level k + 1, and a rank directory over that bitmap: counts before each block of 65,536 bits
and, within a block, before each word of 64.  The id at a place is read by following its chunks down the levels; nothing
before it is decoded.

Documents are dealt to partitions by ranges of their order.  A partition's ids form one stream, cut every ``SEGMENT`` ids,
so the place of an id names its segment: a long document spans several, a segment holds many short ones.  Segments are
rows of a Parquet table, so Spark's commit protocol guards them on any file system.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapewell.llm.words import U, bytes_of, slices

SEGMENT = 1 << 20
BATCH = 6_000_000
WORDS_KEPT = 800_000
MAGIC = b"DAC1"
MARK = "\x01"
STOPS = b".,;:!?)"

# Byte classes: 0 white space, 1 others, 2 ASCII letters, 3 stops; and bytes with every white space as a blank.
_KIND = np.ones(256, np.uint8)
_KIND[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = 0
_KIND[65:91] = _KIND[97:123] = 2
_KIND[list(STOPS)] = 3
_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[[0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = 32


class Level:
    def __init__(self, chunk: np.ndarray, more: np.ndarray, block: np.ndarray, inner: np.ndarray) -> None:
        self.chunk, self.more, self.block, self.inner = chunk, more, block, inner

    @classmethod
    def of(cls, chunk: np.ndarray, on: np.ndarray) -> Level:
        padded = np.zeros(-(-len(on) // 64) * 64, np.uint8)
        padded[: len(on)] = on
        more = np.packbits(padded, bitorder="little").view("<u8")
        before = np.cumsum(np.bitwise_count(more), dtype=np.int64) - np.bitwise_count(more)
        block = before[::1024]
        inner = before - np.repeat(block, 1024)[: len(before)]
        return cls(chunk, more, block.astype("<u4"), inner.astype("<u2"))

    def goes_on(self, at: np.ndarray) -> np.ndarray:
        return (self.more[at >> 6] >> (at & 63).astype(U) & U(1)).astype(bool)

    def rank(self, at: np.ndarray) -> np.ndarray:
        """How many of the chunks before each place go on."""
        word = at >> 6
        part = np.bitwise_count(self.more[word] & ((U(1) << (at & 63).astype(U)) - U(1)))
        return self.block[word >> 10].astype(np.int64) + self.inner[word] + part


class TokenFile:
    """One segment: ``at`` gives the ids at any places."""

    def __init__(self, levels: list[Level], size: int) -> None:
        self.levels, self.size = levels, size

    @classmethod
    def encode(cls, ids: np.ndarray) -> TokenFile:
        rest, levels = ids.astype(np.uint32), []
        while len(rest):
            on = rest > 255
            levels.append(Level.of((rest & 255).astype(np.uint8), on))
            rest = rest[on] >> 8
        return cls(levels, len(ids))

    def at(self, place: np.ndarray) -> np.ndarray:
        out = np.zeros(len(place), np.uint32)
        live, at = np.arange(len(place)), np.asarray(place, np.int64)
        for k, level in enumerate(self.levels):
            out[live] |= level.chunk[at].astype(np.uint32) << np.uint32(8 * k)
            on = level.goes_on(at)
            live, at = live[on], level.rank(at[on])
        return out

    def slice(self, begin: int, end: int) -> np.ndarray:
        return self.at(np.arange(begin, end))

    def to_bytes(self) -> bytes:
        out = [MAGIC, np.array([len(self.levels), self.size], "<u4").tobytes()]
        for x in self.levels:
            out += [np.array([len(x.chunk)], "<u4").tobytes(), x.chunk.tobytes(), x.more.tobytes(), x.block.tobytes(), x.inner.tobytes()]
        return b"".join(out)

    @classmethod
    def from_bytes(cls, image: bytes) -> TokenFile:
        if image[:4] != MAGIC:
            raise ValueError("not a token file")
        count, size = np.frombuffer(image, "<u4", 2, 4).tolist()
        levels, at = [], 12
        for _ in range(count):
            n = int(np.frombuffer(image, "<u4", 1, at)[0])
            words = -(-n // 64)
            at += 4
            fields = []
            for kind, m in (("u1", n), ("<u8", words), ("<u4", -(-words // 1024)), ("<u2", words)):
                fields.append(np.frombuffer(image, kind, m, at))
                at += fields[-1].nbytes
            levels.append(Level(*fields))
        return cls(levels, size)


class Encoder:
    """The public tokenizer, asked once for each different word.

    Its rule never joins characters over white space, nor an ASCII letter with one of the ``STOPS`` behind it, so a text's
    ids are those of its words and stops, one after the other.  ``MARK`` parts the words of one question.
    """

    def __init__(self, description: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs the tasks side by side
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(description)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.mark = self._asked([MARK])[0]
        assert len(self.mark) == 1
        self._forget()

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}  # a word's number
        self.bounds, self.flat = np.zeros(1, np.int64), np.zeros(0, np.uint32)

    def _asked(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _learn(self, fresh: list[bytes]) -> None:
        """Ids of new words, many to a question; words that hold the mark are asked one by one."""
        marked = [w for w in fresh if MARK.encode() in w]
        plain = [w for w in fresh if MARK.encode() not in w]
        ids = []
        for group in range(0, len(plain), 1 << 16):
            part = plain[group : group + (1 << 16)]
            joined = [(b" " + MARK.encode() + b" ").join([*part[i : i + 128], b""]).decode() for i in range(0, len(part), 128)]
            ids += [np.array(i, np.uint32) for i in self._asked(joined)]
        flat = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
        cut = np.flatnonzero(flat == self.mark[0])
        size = np.diff(cut, prepend=-1) - 1
        alone = self._asked([w.decode() for w in marked])
        flat = np.concatenate([self.flat, np.delete(flat, cut), *(np.array(i, np.uint32) for i in alone)])
        size = np.concatenate([size, np.array([len(i) for i in alone], np.int64)])
        self.known.update(zip(plain + marked, range(len(self.known), len(self.known) + len(fresh)), strict=True))
        self.bounds = np.append(self.bounds, self.bounds[-1] + np.cumsum(size))
        self.flat = flat

    def _numbers(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        fresh = [w for w in dict.fromkeys(words) if w not in known]
        if fresh and len(known) + len(fresh) > WORDS_KEPT:
            self._forget()
            known, fresh = self.known, list(dict.fromkeys(words))
        if fresh:
            self._learn(fresh)
        return np.fromiter((known[w] for w in words), np.int64, len(words))

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a column, and the bounds of each text's share; null counts as the empty text."""
        data, offsets = bytes_of(column)
        texts = len(offsets) - 1
        kind = _KIND[data]
        begins = kind > 0  # a value begins with a word's first byte, or with a stop behind a letter
        begins[1:] &= (kind[:-1] == 0) | (kind[1:] == 3) & (kind[:-1] == 2)
        inner = offsets[:-1][offsets[:-1] < len(data)]
        begins[inner] = kind[inner] > 0
        start = np.flatnonzero(begins)
        if not len(start):
            return np.zeros(0, np.uint32), np.zeros(texts + 1, np.int64)
        data = _PLAIN[data]
        # A value reaches to the next one, so values stand side by side; white space between them counts as its end.
        values = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(np.append(start, len(data)).astype(np.int64)), pa.py_buffer(data)])
        coded = values.dictionary_encode()
        words = [v.rstrip(b" ") for v in coded.dictionary.to_pylist()]
        words = [w.lower() if w.isascii() and b"<" not in w else w for w in words]  # its rule folds case, but not in names of special tokens
        number = self._numbers(words)[coded.indices.to_numpy()]
        begin = self.bounds[number]
        size = self.bounds[number + 1] - begin
        done = np.cumsum(size)
        out = self.flat[np.arange(int(done[-1])) + np.repeat(begin - (done - size), size)]
        return out, np.append(0, done)[np.searchsorted(start, offsets)]


_ENCODERS: dict[str, Encoder] = {}


def _encoder(description: str) -> Encoder:
    key = hashlib.sha256(description.encode()).hexdigest()
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(description)
    return _ENCODERS[key]


_SEGMENTS = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("first_row", pa.int64()), ("n_tokens", pa.int64()), ("doc_ids", pa.list_(pa.int64())),
                       ("begins", pa.list_(pa.int64())), ("goes_on", pa.bool_()), ("image", pa.binary())])
_SEGMENT_DDL = "part int, seq int, first_row long, n_tokens long, doc_ids array<long>, begins array<long>, goes_on boolean, image binary"


class _Writer:
    """The stream of one partition: takes documents, gives whole segments."""

    def __init__(self, part: int, segment: int) -> None:
        self.part, self.segment = part, segment
        self.seq, self.row = 0, 0
        self.ids: list[np.ndarray] = []
        self.held = 0
        self.docs: list[int | None] = []
        self.begins: list[int] = []

    def add(self, doc: int | None, ids: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.docs.append(doc)
        self.begins.append(self.held)
        while self.held + len(ids) >= self.segment:
            room = self.segment - self.held
            ids, now = ids[room:], ids[:room]
            self.ids.append(now)
            self.held += room
            yield self.cut(len(ids) > 0, doc)
        if len(ids):
            self.ids.append(ids)
            self.held += len(ids)

    def cut(self, goes_on: bool = False, doc: int | None = None) -> pa.RecordBatch:
        image = TokenFile.encode(np.concatenate(self.ids)).to_bytes()
        row = [self.part, self.seq, self.row, self.held, self.docs, self.begins, goes_on, image]
        self.row += len(self.docs) - goes_on
        self.seq, self.ids, self.held = self.seq + 1, [], 0
        self.docs, self.begins = ([doc], [-1]) if goes_on else ([], [])
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, _SEGMENTS, strict=True)], schema=_SEGMENTS)


def segments(documents: DataFrame, path: str, end_id: int = 1, segment: int = SEGMENT) -> DataFrame:
    """The documents' token ids, each document closed by ``end_id``, as segments of ``segment`` ids.

    Order: ascending doc_id, null ids first; rows of one id in the order of a hash of their texts.  Null and empty texts
    have the end id only.  Rows that repeat stay, each with its own ids.  Other columns are ignored.

    ``part`` and ``seq`` name a segment; ``doc_ids`` and ``begins`` list its documents and their first ids (-1: the
    document began in an earlier segment); with ``goes_on`` the last one ends in a later segment.
    """
    spark = documents.sparkSession
    model = spark.sparkContext.broadcast(Path(path).read_text())  # a fixed 3 MB
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumns({"tie": F.xxhash64("text"), "salt": F.rand(11)})  # the salt parts rows that repeat a lot

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(model.value)
        writer = _Writer(TaskContext.get().partitionId(), segment)
        for batch in batches:
            for part in slices(batch, size=BATCH):
                ids, bounds = encoder.encode(part.column(1))
                for k, doc in enumerate(part.column(0).to_pylist()):
                    yield from writer.add(doc, np.append(ids[bounds[k] : bounds[k + 1]], np.uint32(end_id)))
        if writer.held:
            yield writer.cut()

    order = ["doc_id", "tie", "salt"]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text").mapInArrow(build, _SEGMENT_DDL)


def write(documents: DataFrame, tokenizer: str, path: str, **options) -> None:
    segments(documents, tokenizer, **options).write.option("compression", "none").parquet(path)


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_SEGMENT_DDL).parquet(path)


def part_starts(files: DataFrame) -> DataFrame:
    """(part, part_start): ids before each partition's stream; one row per partition of the writing job."""
    sizes = files.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_start"))


_PIECES = pa.schema([("part", pa.int32()), ("row", pa.int64()), ("seq", pa.int32()), ("doc_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary())])


def _pieces(files: DataFrame, segment: int, whole: bool) -> DataFrame:
    """Documents that lie in one segment, or the pieces of those that don't, decoded from their segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                x = batch.slice(k, 1).to_pylist()[0]
                file = TokenFile.from_bytes(x["image"])
                n = len(x["doc_ids"])
                begin = np.array(x["begins"], np.int64)
                partial = begin < 0
                partial[-1] |= x["goes_on"]
                begin = np.maximum(begin, 0)
                end = np.append(begin[1:], file.size)
                use = np.flatnonzero(partial != whole)
                if not len(use):
                    continue
                lo, hi = int(begin[use[0]]), int(end[use[-1]])
                if whole:
                    ids = file.slice(lo, hi).astype("<u4").tobytes()
                    found = [ids[4 * (int(begin[d]) - lo) : 4 * (int(end[d]) - lo)] for d in use]
                else:
                    found = [file.slice(int(begin[d]), int(end[d])).astype("<u4").tobytes() for d in use]
                columns = [[x["part"]] * len(use), use + x["first_row"], [x["seq"]] * len(use), [x["doc_ids"][d] for d in use], begin[use] + x["seq"] * segment, found]
                assert n == len(begin)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _PIECES, strict=True)], schema=_PIECES)

    return files.mapInArrow(run, "part int, row long, seq int, doc_id long, offset long, ids binary")


def read(files: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """(doc_id, start, ids) of every document of the files: the ids before it in all files, and its own ids with the end
    id, as little-endian unsigned 32-bit integers (a document's ids must fit a binary value of 2 GB)."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [b"".join(p["ids"] for p in pieces) for pieces in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(ids, pa.binary())], ["part", "doc_id", "offset", "ids"])

    whole = _pieces(files, segment, True).select("part", "doc_id", "offset", "ids")
    pieces = F.array_sort(F.collect_list(F.struct("seq", "ids"))).alias("pieces")  # no more than one document
    long = _pieces(files, segment, False).groupBy("part", "row").agg(F.max("doc_id").alias("doc_id"), F.min("offset").alias("offset"), pieces)
    long = long.select("part", "doc_id", "offset", "pieces").mapInArrow(join, "part int, doc_id long, offset long, ids binary")
    out = whole.unionByName(long).join(F.broadcast(part_starts(files)), "part")  # one row per partition of the writing job
    return out.select("doc_id", (F.col("part_start") + F.col("offset")).alias("start"), "ids")


def fetch(files: DataFrame, wanted: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """The rows of ``wanted`` (position, ...) with the token ``id`` at that place of all files; null where there is none.

    A position names its segment, and each segment looks up its different positions only, ``segment`` at most.
    """
    rows = part_starts(files).orderBy("part").collect()  # one per partition of the writing job
    starts, parts = np.array([r.part_start for r in rows], np.int64), np.array([r.part for r in rows], np.int32)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            k = np.searchsorted(starts, at, "right") - 1
            inside = at - starts[k]
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(parts[k]), pa.array((inside // segment).astype(np.int32)), pa.array(inside % segment)], ["position", "part", "seq", "inner"])

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.to_pylist():
                file = TokenFile.from_bytes(x["image"])
                asked = [a for a in x["asked"] if a["inner"] < file.size]
                ids = file.at(np.array([a["inner"] for a in asked], np.int64))
                yield pa.RecordBatch.from_arrays([pa.array([a["position"] for a in asked], pa.int64()), pa.array(ids.astype(np.int64))], ["position", "id"])

    found = wanted.sparkSession.createDataFrame([], "position long, id long")
    if rows:
        places = wanted.select(F.col("position").cast("long").alias("position")).where("position >= 0").distinct().mapInArrow(place, "position long, part int, seq int, inner long")
        asked = places.groupBy("part", "seq").agg(F.collect_list(F.struct("position", "inner")).alias("asked"))
        found = files.select("part", "seq", "image").join(asked, ["part", "seq"]).select("image", "asked").mapInArrow(look, "position long, id long")
    return wanted.drop("id").join(found, "position", "left")
