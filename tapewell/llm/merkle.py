"""A Merkle tree over table rows, and octopus multiproofs of all its leaves.

Leaves are numbered per key (numbers of sorted ranges plus counts of the ranges before) and gathered into blocks of
``BLOCK`` consecutive leaves.  A block is one leaf partition: everything below its top is worked out from its own leaves.
Block tops climb the rest of the tree in rounds of ``BLOCK`` nodes to a group, so three rounds reach 6.9e10 leaves.

For proofs each leaf partition lists the minimal union of coordinates that its leaves need and can't derive, fetches those
nodes once, derives the shared interior nodes from its leaves, and writes out the path of every leaf from both.  The
subroots of all keys are leaves of a second tree of the same kind.

A path is a list of steps from a leaf to the root: ``L`` or ``R`` and the sibling's digest, by the side it stands on, or
``-`` where a node is alone in its run.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapewell.session import checkpointed

LEVELS = 12
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(values: Sequence[Column]) -> Column:
    """SHA-256 (binary) of the values: ``-`` for null, else byte count, colon, value."""
    text = [v.cast("string") for v in values]
    return F.unhex(F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in text]), 256))


def leaves(documents: DataFrame, fields: Sequence[str] = FIELDS, key: str = "lang", changed: Mapping[str, Column] | None = None) -> DataFrame:
    """(key, id, leaf, candidate) of each row; ``candidate`` is the leaf with the ``changed`` columns, which is to be
    verified.  ``key`` is the empty string for null, else ``=`` and the value, and so sorts null first, then bytewise."""
    new = {**{f: F.col(f"`{f}`") for f in fields}, **(changed or {})}
    name = F.col(f"`{key}`").cast("string")
    return documents.select(
        F.when(name.isNull(), "").otherwise(F.concat(F.lit("="), name)).alias("key"), F.col("doc_id").cast("long").alias("id"),
        digest([F.col(f"`{f}`") for f in fields]).alias("leaf"), digest([new[f] for f in fields]).alias("candidate"))


def _numbered(rows: DataFrame) -> DataFrame:
    """``rows`` (key, id, leaf, ...) with ``index``, from 0 within the key by (id, leaf), and the key's ``width``."""
    order = ["key", "id", "leaf", "_salt"]  # the salt parts rows that repeat a lot
    ranges = rows.withColumn("_salt", F.rand(12)).repartitionByRange(*order).sortWithinPartitions(*order).drop("_salt")
    placed = checkpointed(ranges.withColumn("_at", F.monotonically_increasing_id())).withColumn("_part", F.shiftright("_at", 33))
    sizes = placed.groupBy("key", "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    w = Window.partitionBy("key")  # one row per range
    before = F.coalesce(F.sum("_n").over(w.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("key", "_part", (before - F.col("_first")).alias("_shift"), F.sum("_n").over(w).alias("width"))
    out = placed.join(offsets, ["key", "_part"])
    return out.withColumn("index", F.col("_at") + F.col("_shift")).drop("_at", "_part", "_shift")


def _up(nodes: np.ndarray) -> np.ndarray:
    """Digests (n x 32 bytes) of the next level: runs of two, the last one may be alone."""
    raw = nodes.tobytes().hex()
    out = [hashlib.sha256(raw[i : i + 128].encode()).digest() for i in range(0, len(raw), 128)]
    return np.frombuffer(b"".join(out), np.uint8).reshape(-1, 32)


def heights(width: int) -> list[int]:
    """Node counts of all levels, from the leaves to the root."""
    out = [width]
    while out[-1] > 1:
        out.append(-(-out[-1] // 2))
    return out


def missing(known: np.ndarray, width: int) -> list[tuple[int, int]]:
    """The minimal union of (level, index) of nodes that prove all ``known`` leaves together and can't be derived from them."""
    known, out = np.unique(known), []
    for level, n in enumerate(heights(width)[:-1]):
        other = known ^ 1
        need = np.setdiff1d(other[other < n], known, assume_unique=True)
        out += [(level, int(i)) for i in need]
        known = np.unique(known >> 1)
    return out


_BLOCK = "key string, block long, width long, ids array<long>, leaves binary, candidates binary, top binary"


def _matrix(x: bytes) -> np.ndarray:
    return np.frombuffer(x, np.uint8).reshape(-1, 32)


def _local(nodes: np.ndarray, width: int, levels: int) -> list[np.ndarray]:
    """Levels of a block's own nodes, from its leaves up to its top."""
    out = [nodes]
    for _ in range(min(levels, len(heights(width)) - 1)):
        out.append(_up(out[-1]))
    return out


def _blocks(numbered: DataFrame, levels: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.to_pylist():
                own = b"".join(r["leaf"] for r in x["rows"])
                top = _local(_matrix(own), x["width"], levels)[-1].tobytes()
                row = [x["key"], x["block"], x["width"], [r["id"] for r in x["rows"]], own, b"".join(r["candidate"] for r in x["rows"]), top]
                kinds = [pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds, strict=True)], ["key", "block", "width", "ids", "leaves", "candidates", "top"])

    rows = F.array_sort(F.collect_list(F.struct("index", "id", "leaf", "candidate"))).alias("rows")  # 2**levels at most
    grouped = numbered.groupBy("key", F.shiftright("index", levels).alias("block")).agg(F.max("width").alias("width"), rows)
    return checkpointed(grouped.mapInArrow(run, _BLOCK))


def _climb(blocks: DataFrame, levels: int) -> DataFrame:
    """(key, level, index, digest) of every node from the block tops up to the roots of all keys."""
    kinds = [pa.string(), pa.int32(), pa.int64(), pa.binary()]

    def climber(base: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for x in batch.to_pylist():
                    nodes = _matrix(b"".join(r["digest"] for r in x["rows"]))
                    counts = heights(x["width"])
                    index = x["group"] << levels
                    for level in range(base + 1, min(base + levels, len(counts) - 1) + 1):
                        nodes, index = _up(nodes), index >> 1
                        n = len(nodes)
                        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip([[x["key"]] * n, [level] * n, range(index, index + n), [bytes(d) for d in nodes]], kinds, strict=True)], ["key", "level", "index", "digest"])

        return run

    ends = blocks.groupBy("key").agg(F.max("width").alias("width"))
    most = ends.agg(F.max("width")).first()[0] or 0
    single = F.ceil(F.log2(F.col("width").cast("double")) - F.lit(1e-12)).cast("int")
    nodes = blocks.select("key", F.least(F.lit(levels), single).cast("int").alias("level"), F.col("block").alias("index"), F.col("top").alias("digest"), "width")
    out, base = nodes.drop("width"), levels
    while (most - 1) >> base > 0:
        rows = F.array_sort(F.collect_list(F.struct("index", "digest"))).alias("rows")
        live = nodes.where((F.col("level") == base) & (F.col("width") > F.lit(1 << base)))
        groups = live.groupBy("key", F.shiftright("index", levels).alias("group")).agg(F.max("width").alias("width"), rows)
        above = checkpointed(groups.mapInArrow(climber(base), "key string, level int, index long, digest binary"))
        out, base = out.unionByName(above), base + levels
        nodes = above.where(F.col("level") == base).join(ends, "key")
    return checkpointed(out)


def _fetched(blocks: DataFrame, nodes: DataFrame, levels: int) -> DataFrame:
    """``blocks`` with ``outside``: the nodes that each leaf partition misses, fetched once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.to_pylist():
                lo = x["block"] << levels
                need = missing(np.arange(lo, min(lo + (1 << levels), x["width"])), x["width"])
                columns = [[x["key"]] * len(need), [x["block"]] * len(need), [c[0] for c in need], [c[1] for c in need]]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(columns, [pa.string(), pa.int64(), pa.int32(), pa.int64()], strict=True)], ["key", "block", "level", "index"])

    asked = blocks.select("key", "block", "width").mapInArrow(run, "key string, block long, level int, index long")
    held = F.collect_list(F.struct("level", "index", "digest")).alias("outside")  # one per level of the tree
    found = asked.join(nodes, ["key", "level", "index"]).groupBy("key", "block").agg(held)
    return blocks.join(found, ["key", "block"], "left")


def _steps(local: list[np.ndarray], outside: dict[tuple[int, int], bytes], first: int, width: int) -> list[list[str]]:
    """For every level, the step of each of the partition's nodes there."""
    out = []
    for level, n in enumerate(heights(width)[:-1]):
        own = [bytes(d).hex() for d in local[level]] if level < len(local) else []
        lo = first >> level
        count = len(own) or 1
        line = []
        for i in range(lo, lo + count):
            j = i ^ 1
            if j >= n:
                line.append("-")
                continue
            sibling = own[j - lo] if lo <= j < lo + len(own) else outside[level, j].hex()
            line.append(("L" if j < i else "R") + sibling)
        out.append(line)
    return out


def fold(leaf: str, path: Sequence[str]) -> str:
    """The root that a leaf's digest and its path lead to."""
    for step in path:
        pair = leaf if step == "-" else step[1:] + leaf if step[0] == "L" else leaf + step[1:]
        leaf = hashlib.sha256(pair.encode()).hexdigest()
    return leaf


_PATHS = "key string, id long, leaf string, subroot string, root string, path array<string>, folded_root string"


def _paths(fetched: DataFrame, levels: int) -> DataFrame:
    """One row per leaf of ``fetched`` (blocks with outside, subroot, root, above): its whole path, and the root that its
    candidate leads to."""
    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.string()]
    names = ["key", "id", "leaf", "subroot", "root", "path", "folded_root"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.to_pylist():
                local = _local(_matrix(x["leaves"]), x["width"], levels)
                outside = {(o["level"], o["index"]): o["digest"] for o in x["outside"] or []}
                steps = _steps(local, outside, x["block"] << levels, x["width"])
                leaf = [bytes(d).hex() for d in local[0]]
                candidate = [bytes(d).hex() for d in _matrix(x["candidates"])]
                paths = [[line[k >> level if len(line) > 1 else 0] for level, line in enumerate(steps)] + x["above"] for k in range(len(leaf))]
                folded = [fold(c, p) for c, p in zip(candidate, paths, strict=True)]
                n = len(leaf)
                columns = [[x["key"]] * n, x["ids"], leaf, [x["subroot"]] * n, [x["root"]] * n, paths, folded]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    return fetched.select("key", "block", "width", "ids", "leaves", "candidates", "outside", "subroot", "root", "above").mapInArrow(run, _PATHS)


def _tree(rows: DataFrame, levels: int) -> tuple[DataFrame, DataFrame]:
    """Blocks with what they fetch, and (key, digest) of each key's root."""
    blocks = _blocks(_numbered(rows), levels)
    nodes = _climb(blocks, levels)
    tops = nodes.groupBy("key").agg(F.max_by("digest", "level").alias("digest"))  # the root is alone on the highest level
    return _fetched(blocks, nodes, levels), tops


def multiproof(leaf_rows: DataFrame, levels: int = LEVELS) -> DataFrame:
    """Paths, subroot and root of every leaf of ``leaves()``, and ``folded_root``, which its candidate leads to.

    Leaves of a key ascend by id, null first; those of one id by digest, and rows that repeat are leaves of their own.  An
    empty table has no rows.  The candidate proves the row if ``folded_root`` equals ``root``.
    """
    below, tops = _tree(checkpointed(leaf_rows), levels)
    tops = checkpointed(tops)
    keys = tops.select(F.lit("").alias("key"), F.lit(None).cast("long").alias("id"), F.encode("key", "utf-8").alias("leaf"), F.col("digest").alias("candidate"))
    # In the upper tree keys stand in order of their names, and their digests are the leaves.
    upper = _numbered(keys).select("key", F.col("index").alias("id"), F.col("candidate").alias("leaf"), "candidate", F.decode("leaf", "utf-8").alias("name"), "index", "width")
    upper = checkpointed(upper)
    blocks = _blocks(upper, levels)
    nodes = _climb(blocks, levels)
    top = nodes.groupBy("key").agg(F.max_by("digest", "level").alias("_root"))
    fetched = _fetched(blocks, nodes, levels).join(top, "key").withColumns(
        {"subroot": F.lit(""), "root": F.lower(F.hex("_root")), "above": F.array().cast("array<string>")})
    above = _paths(fetched, levels).join(upper.select("id", "name"), "id")
    outer = above.select(F.col("name").alias("key"), F.col("leaf").alias("subroot"), "root", F.col("path").alias("above"))
    return _paths(below.join(outer, "key"), levels)


def proof(path: Column) -> Column:
    """The siblings' digests of a path, joined."""
    return F.array_join(F.transform(path, lambda p: F.substring(p, 2, 64)), "")
