"""Exact n-gram Jaccard join through a token-group matrix.

Equal shingle sets collapse to one representative first.  Tokens have one global order, rare ones first, and two sets
that reach the threshold share a token among the first ``n - ceil(t n) + 1`` of each.  The representatives are
partitioned into groups by one such token that other sets have too, so that similar documents meet in few groups.  Taking twice as many first tokens makes them share at least the smaller slack ``n - ceil(t n) + 1``.  The matrix holds, for each token, the groups whose members have it, with the range of their sizes; joining
it with a query's tokens bounds what the query can share with a group, and only groups that pass are opened.  An
opened group stores the union of its members' tokens: queries that have too few tokens in it are dropped, and the
rest are compared exactly with the members, in blocks of bounded size.  Out come a document's number of links and one
row that ties it to its part of the block, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapewell.llm.components import components
from tapewell.llm.words import U, mix, shingle_sets, slices, words_of
from tapewell.session import checkpointed

SAMPLE_SETS = 4096
COMMON_TOKENS = 1 << 16
BLOCK = 1024


def _set_keys(documents: DataFrame, n: int) -> DataFrame:
    """(doc_id, n_shingles, k1, k2): size and 128-bit identity of every document's set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                h, at = shingle_sets(words_of(part.column(1), True), n)
                size = np.diff(at)
                keys = []
                for k in (U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F)):
                    total = np.concatenate([np.zeros(1, U), np.cumsum(mix(h * k + U(1)))])
                    keys.append(mix(total[at[1:]] - total[at[:-1]] + size.astype(U)).view(np.int64))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(size), *map(pa.array, keys)], ["doc_id", "n_shingles", "k1", "k2"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, k1 long, k2 long")


def _common_tokens(sets: DataFrame, n: int, total: int) -> np.ndarray:
    """Tokens that occur in several documents of a bounded sample, rarest first: they go last in the global order.

    Any order gives exact results; this one only keeps shared passages out of the compared prefixes.
    """
    share = min(1.0, SAMPLE_SETS / max(total, 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                h, _ = shingle_sets(words_of(part.column(1), True), n)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64))], ["h"])

    sample = sets.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30))))
    found = sample.select("doc_id", "text").mapInArrow(run, "h long").groupBy("h").count().where("count >= 3")
    rows = found.orderBy(F.desc("count"), "h").limit(COMMON_TOKENS).collect()  # 65,536 pairs at most
    return np.array([r[0] for r in rows[::-1]], np.int64).view(U)


def _ordered(h: np.ndarray, common: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Tokens as positions in the global order (62 bits of hash; common ones above all others)."""
    out = (h >> U(2)).astype(np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, h), len(common) - 1)
        hit = common[at] == h
        out[hit] = (1 << 62) + place[at[hit]]
    return out


def _slack(n, percent: int):
    """Tokens of a set of ``n`` that a partner may lack, plus one."""
    return n - (percent * n + 99) // 100 + 1


def _prefixes(texts: DataFrame, n: int, percent: int, common) -> DataFrame:
    """(doc, n, toks): the first tokens of every document in the global order, twice its slack less one.

    Two sets that link share at least the smaller of their slacks among these.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = common.value
        order = np.argsort(tokens)
        for batch in batches:
            for part in slices(batch):
                h, at = shingle_sets(words_of(part.column(1), True), n)
                size = np.diff(at)
                doc = np.repeat(np.arange(len(size)), size)
                pos = _ordered(h, tokens[order], order)
                pos = pos[np.lexsort((pos, doc))]
                length = np.minimum(size, 2 * _slack(size, percent) - 1)
                length[size == 0] = 0
                head = np.arange(len(h)) - at[doc] < length[doc]
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(length)]), pa.int32()), pa.array(pos[head]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(size.astype(np.int32)), lists], ["doc", "n", "toks"])

    return texts.mapInArrow(run, "doc long, n int, toks array<long>")


def _open_groups(rows: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Rows (unit, doc, member, query, copies, shingles) ordered by unit -> (doc, links, root) of queries that link."""
    held: list[tuple] = []
    unit = None
    for batch in rows:
        cols = [batch.column(c).to_pylist() for c in ("unit", "doc", "member", "query", "copies", "shingles")]
        for row in zip(*cols, strict=True):
            if row[0] != unit:
                if len(held) > 1:
                    yield from _compare(held, percent)
                held, unit = [], row[0]
            held.append(row[1:])
    if len(held) > 1:
        yield from _compare(held, percent)


def _compare(rows: list[tuple], percent: int) -> Iterator[pa.RecordBatch]:
    ids = np.array([r[0] for r in rows], np.int64)
    member, query = np.array([r[1] for r in rows], bool), np.array([r[2] for r in rows], bool)
    sets = [np.frombuffer(r[4], np.int64) for r in rows]
    size = np.array([len(s) for s in sets], np.int64)
    token, place, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(rows)), size)
    union = np.bincount(place, weights=member[owner], minlength=len(token)) > 0
    useful = union & (count > 1)
    # What a set can share with any other set here; too little closes the group for it.
    bound = np.bincount(owner, weights=useful[place], minlength=len(rows))
    live = bound * 100 >= percent * size
    use = useful[place] & live[owner]
    column = np.full(len(token), -1, np.int64)
    used = np.unique(place[use])
    column[used] = np.arange(len(used))
    number = np.cumsum(live) - 1
    m = int(live.sum())
    if m < 2:
        return
    row, col = number[owner[use]], column[place[use]]
    shared = np.zeros((m, m), np.float32)
    width = max(1, 8_000_000 // m)
    for lo in range(0, len(used), width):
        part = (col >= lo) & (col < lo + width)
        block = np.zeros((m, min(width, len(used) - lo)), np.float32)
        block[row[part], col[part] - lo] = 1
        shared += block @ block.T
    n = size[live].astype(np.float64)
    near = shared * 100.0 >= percent * (n[:, None] + n[None, :] - shared)
    near &= ids[live][:, None] != ids[live][None, :]
    q, p = query[live], member[live]
    copies = np.array([r[3] for r in rows], np.int64)[live]
    links = (near & p[None, :]) @ copies
    links[~q] = 0
    near &= (q[:, None] & p[None, :]) | (p[:, None] & q[None, :])
    label = ids[live]
    while True:
        least = np.minimum(label, np.where(near, label[None, :], np.iinfo(np.int64).max).min(axis=1))
        if (least == label).all():
            break
        label = least
    out = near.any(axis=1)
    if out.any():
        yield pa.RecordBatch.from_arrays([pa.array(ids[live][out]), pa.array(links[out]), pa.array(label[out])], ["doc", "links", "root"])


def join(documents: DataFrame, n: int = 4, percent: int = 85) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links) of every row of ``documents`` (doc_id, text, ...).

    Two documents link when 100 * intersection >= percent * union of their sets of distinct ``n``-word shingles, A-Z
    lower-cased; fewer words make one shingle.  ``component_id`` is the smallest doc_id reachable by links and
    ``n_links`` the number of other documents linked directly, copies included.  Empty and null texts have
    n_shingles 0 and link with nothing.  Null ids link with nothing and have a null component.  An id that comes
    twice counts as one document with either text.  Other columns are ignored.
    """
    spark = documents.sparkSession
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    keys = checkpointed(_set_keys(texts, n))
    live = keys.where("n_shingles > 0 and doc_id is not null")
    same = checkpointed(live.groupBy("k1", "k2", "n_shingles").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")))
    total = same.count()
    common = spark.sparkContext.broadcast(_common_tokens(texts, n, keys.count()))

    # The compared tokens that at least two sets have.  The first of those that are about as frequent as a document's
    # most frequent one names its group: copies with edits of their own, rare as these are, still meet in a few groups.
    heads = _prefixes(texts, n, percent, common) if total > 1 else spark.createDataFrame([], "doc long, n int, toks array<long>")
    heads = heads.join(same.select(F.col("rep").alias("doc"), F.col("n_shingles").cast("int").alias("n")), ["doc", "n"]).select("doc", "n", F.explode("toks").alias("tok"))
    heads = heads.withColumn("df", F.count("*").over(Window.partitionBy("tok"))).where("df > 1")
    of_doc = Window.partitionBy("doc")
    heads = heads.withColumn("top", F.max("df").over(of_doc)).withColumn("g", F.min(F.when(F.col("df") * 2 >= F.col("top"), F.col("tok"))).over(of_doc))
    heads = checkpointed(heads.select("tok", "doc", "n", "g"))

    # Matrix row: the groups that have a token, and the sizes of their members there.  A query asks the groups with
    # which it shares as many of these tokens as with its smallest possible partner.
    matrix = heads.groupBy("tok", "g").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.count("*").alias("m"))
    fits = (F.col("lo") * percent <= F.col("n") * 100) & (F.col("n") * percent <= F.col("hi") * 100) & ((F.col("m") > 1) | (F.col("g") != F.col("own")))
    shared = heads.select("tok", "doc", "n", F.col("g").alias("own")).join(matrix, "tok").where(fits).groupBy("doc", "g").agg(F.count("*").alias("c"), F.first("n").alias("n"))
    smallest = F.ceil(F.col("n") * percent / 100)
    asked = checkpointed(shared.where(F.col("c") >= smallest - F.ceil(smallest * percent / 100) + 1).select("doc", "g"))
    roles = asked.select("doc", "g", F.lit(False).alias("member"), F.lit(True).alias("query"))
    # Links go both ways, so a member that asks no group has no partner.
    members = heads.select("doc", "g").distinct().join(asked.select("g").distinct(), "g").join(asked.select("doc").distinct(), "doc", "left_semi").select("doc", "g")
    roles = roles.union(members.select("doc", "g", F.lit(True), F.lit(False))).groupBy("doc", "g").agg(F.max("member").alias("member"), F.max("query").alias("query"))
    roles = checkpointed(roles)

    # Groups beyond a block are opened block by block: members in blocks, queries in blocks, each pair of blocks once.
    sizes = roles.groupBy("g").agg(F.count_if("member").alias("members"), F.count_if("query").alias("queries"), F.count("*").alias("all")).where("members > 0 and queries > 0 and `all` > 1")
    small = sizes.where(F.col("all") <= BLOCK).select("g")
    large = sizes.where(F.col("all") > BLOCK).select("g", F.ceil(F.col("members") / BLOCK).alias("mb"), F.ceil(F.col("queries") / BLOCK).alias("qb"))
    blocks = roles.join(large, "g").withColumn("h", F.xxhash64("doc"))
    every = lambda k: F.sequence(F.lit(0).cast("long"), F.col(k) - 1)
    as_member = blocks.where("member").withColumn("i", F.pmod("h", F.col("mb"))).withColumn("j", F.explode(every("qb"))).select("doc", F.xxhash64("g", "i", "j").alias("unit"), "member", F.lit(False).alias("query"))
    as_query = blocks.where("query").withColumn("j", F.pmod("h", F.col("qb"))).withColumn("i", F.explode(every("mb"))).select("doc", F.xxhash64("g", "i", "j").alias("unit"), F.lit(False).alias("member"), "query")
    units = as_member.union(as_query).groupBy("doc", "unit").agg(F.max("member").alias("member"), F.max("query").alias("query"))
    units = roles.join(small, "g").select("doc", F.col("g").alias("unit"), "member", "query").union(units)
    wanted = units.groupBy("doc").agg(F.collect_list(F.struct("unit", "member", "query")).alias("units"))

    def ship(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                h, at = shingle_sets(words_of(part.column(1), True), n)
                out = [(u["unit"], doc, u["member"], u["query"], copies, h[at[d] : at[d + 1]].tobytes())
                       for d, (doc, copies, us) in enumerate(zip(part.column(0).to_pylist(), part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)) for u in us]
                yield pa.RecordBatch.from_pylist([dict(zip(("unit", "doc", "member", "query", "copies", "shingles"), o, strict=True)) for o in out], schema=shipped)

    shipped = pa.schema([("unit", pa.int64()), ("doc", pa.int64()), ("member", pa.bool_()), ("query", pa.bool_()), ("copies", pa.int64()), ("shingles", pa.binary())])
    wanted = wanted.join(same.select(F.col("rep").alias("doc"), "copies"), "doc")
    full = texts.join(wanted.withColumnRenamed("doc", "doc_id"), "doc_id").select("doc_id", "text", "copies", "units")
    opened = full.mapInArrow(ship, "unit long, doc long, member boolean, query boolean, copies long, shingles binary")
    opened = opened.repartition("unit").sortWithinPartitions("unit")
    found = checkpointed(opened.mapInArrow(lambda it: _open_groups(it, percent), "doc long, links long, root long"))

    parts = components(found.select(F.col("doc").alias("a"), F.col("root").alias("b")))
    degree = found.groupBy("doc").agg(F.sum("links").alias("links"))
    same = same.join(parts.withColumnRenamed("id", "rep"), "rep", "left").join(degree.withColumnRenamed("doc", "rep"), "rep", "left")
    own = same.select("k1", "k2", "n_shingles", F.coalesce("component", "rep").alias("c"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("l"))
    joined = keys.join(own, ["k1", "k2", "n_shingles"], "left")
    linked = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    return joined.select("doc_id", "n_shingles", F.when(linked, F.col("c")).otherwise(F.col("doc_id")).alias("component_id"), F.when(linked, F.col("l")).otherwise(F.lit(0)).alias("n_links"))


def keep_one(documents: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``documents`` that stay: of each component the one with the smallest id, once; null ids all stay."""
    lost = join(documents, n, percent).where("component_id != doc_id").select("doc_id").distinct()
    named = documents.where("doc_id is not null").join(lost, "doc_id", "left_anti").dropDuplicates(["doc_id"])
    return named.select(documents.columns).unionByName(documents.where("doc_id is null"))
