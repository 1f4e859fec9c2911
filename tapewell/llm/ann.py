"""Approximate nearest neighbours with a forest of random-projection trees.

The splits of every tree are fitted on a bounded sample: a random direction between two sampled vectors, cut at the
median.  All vectors are then indexed by the leaf they fall into, and a query searches all trees through one shared
priority queue, nearest margins first, until it has opened a fixed share of all leaves, so that it sees the same share
of the table at every size.  Leaf members and queries meet in one task per leaf and are compared there exactly; only
each query's best go on.

Equal vectors are indexed once with their ``k + 1`` smallest ids, which are all that any result can need, so a vector
that a third of the rows share is one entry.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapewell.session import checkpointed

SAMPLE = 16_384
TREES = 16
LEAF = 24  # sampled vectors in a leaf
LEAVES = 220  # least number of leaves that a query opens
SHARE = 16  # one in so many of the forest's leaves is opened
BLOCK = 256  # queries compared with one batch of members at a time


class Forest:
    """Trees as arrays of nodes: direction, cut, and children (a leaf's child is minus its number less one)."""

    def __init__(self, sample: np.ndarray, trees: int, leaf: int, seed: int) -> None:
        rng = np.random.default_rng(seed)
        unit = sample / np.linalg.norm(sample, axis=1, keepdims=True) if len(sample) else sample
        self.trees = [self._grow(unit, leaf, rng) for _ in range(trees)]

    @staticmethod
    def _grow(x: np.ndarray, leaf: int, rng: np.random.Generator) -> tuple:
        directions, cuts, children = [], [], []
        leaves = 0
        stack = [(np.arange(len(x)), -1, 0)]
        root = None
        while stack:
            rows, parent, side = stack.pop()
            me = -1 - leaves
            if len(rows) > leaf:
                a, b = x[rng.choice(rows, 2, replace=False)]
                d = a - b
                at = x[rows] @ d
                cut = np.median(at)
                left = at < cut
                if 0 < left.sum() < len(rows):
                    me = len(cuts)
                    directions.append(d)
                    cuts.append(cut)
                    children.append([0, 0])
                    stack += [(rows[left], me, 0), (rows[~left], me, 1)]
            if me < 0:
                leaves += 1
            if parent < 0:
                root = me
            else:
                children[parent][side] = me
        width = x.shape[1] if len(x) else 1
        return np.array(directions, np.float32).reshape(-1, width), np.array(cuts), np.array(children, np.int64).reshape(-1, 2), root

    def place(self, x: np.ndarray) -> np.ndarray:
        """The leaf of every row of ``x`` in every tree."""
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
        out = np.empty((len(x), len(self.trees)), np.int64)
        for t, (directions, cuts, children, root) in enumerate(self.trees):
            node = np.full(len(x), root)
            live = np.flatnonzero(node >= 0)
            while len(live):
                n = node[live]
                right = np.einsum("ij,ij->i", x[live], directions[n]) >= cuts[n]
                node[live] = children[n, right.astype(int)]
                live = live[node[live] >= 0]
            out[:, t] = -1 - node
        return out

    def opened(self) -> int:
        """How many leaves a query opens: one in ``SHARE`` of all, ``LEAVES`` at least."""
        return max(LEAVES, -(-sum(len(cuts) + 1 for _, cuts, _, _ in self.trees) // SHARE))

    def search(self, q: np.ndarray, leaves: int) -> list[tuple[int, int]]:
        """The ``leaves`` leaves (tree, leaf) of least margin, by one priority queue over all trees."""
        q = q / np.linalg.norm(q)
        side = [(d @ q - c) / np.maximum(np.linalg.norm(d, axis=1), 1e-12) if len(c) else c for d, c, _, _ in self.trees]
        heap = [(0.0, t, tree[3]) for t, tree in enumerate(self.trees)]
        out = []
        while heap and len(out) < leaves:
            margin, t, node = heapq.heappop(heap)
            if node < 0:
                out.append((t, int(-1 - node)))
                continue
            m = float(side[t][node])
            left, right = self.trees[t][2][node]
            heapq.heappush(heap, (max(margin, m), t, int(left)))
            heapq.heappush(heap, (max(margin, -m), t, int(right)))
        return out


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<f8").reshape(len(column), -1)


def _leaf_rows(forest, tree_leaves: list, ids: list, vectors: list, member: bool) -> pa.RecordBatch:
    unit = [t << 32 | leaf for t, leaf in tree_leaves]
    return pa.RecordBatch.from_arrays([pa.array(unit, pa.int64()), pa.array([member] * len(unit), pa.bool_()), pa.array(ids, pa.int64()), pa.array(vectors, pa.binary())], ["unit", "member", "rep", "v"])


def _compare(batches: Iterator[pa.RecordBatch], keep: int) -> Iterator[pa.RecordBatch]:
    """Rows ordered by (unit, member), queries first: each query's ``keep`` best members of the leaf.

    Members stream past the queries of their leaf, so memory holds those and one batch."""
    unit, names, queries, best = None, [], None, []

    def flush():
        if best:
            q, r, s = (np.concatenate(x) for x in zip(*best, strict=True))
            order = np.lexsort((r, -s, q))
            q, r, s = q[order], r[order], s[order]
            first = np.searchsorted(q, q)
            on = np.arange(len(q)) - first < keep
            yield pa.RecordBatch.from_arrays([pa.array(q[on]), pa.array(r[on]), pa.array(s[on])], ["q", "rep", "score"])

    for batch in batches:
        units, member = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
        ids = batch.column(2).to_numpy()
        for a, b in zip(cut := np.flatnonzero(np.r_[True, (units[1:] != units[:-1]) | (member[1:] != member[:-1])]).tolist(), [*cut[1:], len(units)], strict=True):
            if units[a] != unit:
                yield from flush()
                unit, names, queries, best = units[a], [], None, []
            if not member[a]:
                names.append((ids[a:b], _matrix(batch.column(3).slice(a, b - a))))
                continue
            if not names:
                continue
            if queries is None:
                queries = np.concatenate([n for n, _ in names]), np.concatenate([m for _, m in names])
            v, own = _matrix(batch.column(3).slice(a, b - a)), ids[a:b]
            length, far = np.sqrt((v * v).sum(axis=1)), -np.linalg.norm(v, axis=1)
            for k in range(0, len(queries[0]), BLOCK):
                q = queries[1][k : k + BLOCK]
                if len(v) > keep + 6:
                    top = np.argpartition((q @ v.T) / far, keep + 5, axis=1)[:, : keep + 6]
                else:
                    top = np.broadcast_to(np.arange(len(v)), (len(q), len(v)))
                score = (v[top] * q[:, None, :]).sum(axis=2) / (length[top] * np.sqrt((q * q).sum(axis=1))[:, None])
                best.append((np.repeat(queries[0][k : k + BLOCK], top.shape[1]), own[top].ravel(), score.ravel()))
    yield from flush()


def neighbours(vectors: DataFrame, queries: DataFrame, k: int = 5, trees: int = TREES, leaf: int = LEAF, leaves: int | None = None, sample: int = SAMPLE, seed: int = 6) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest rows found for each row of ``queries`` by largest cosine.

    ``vectors`` and ``queries`` have vec_id and embedding; queries are rows of ``vectors``, and a query is no candidate
    of its own.  A query opens ``leaves`` leaves; unset, a share of the forest's leaves (``Forest.opened``).  Scores are
    cosines in double precision; ties go to the smaller vec_id.  Null ids, and vectors that are
    null, empty, zero or hold null or non-finite components, take no part.  Vectors of each length are searched among
    themselves, one length after the other.  A repeated id with one vector counts once.  Other columns are ignored.
    """

    def valid(df: DataFrame) -> DataFrame:
        e = F.col("embedding")
        good = F.forall(e, lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x)) & F.exists(e, lambda x: x != 0)
        return df.select(F.col("vec_id").cast("long").alias("vec_id"), e.cast("array<double>").alias("embedding")).where(F.col("vec_id").isNotNull() & good)

    rows, asked = valid(vectors), valid(queries)
    widths = sorted(r[0] for r in asked.select(F.size("embedding")).distinct().collect())  # the sizes that models give
    out = vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    for n, width in enumerate(widths):
        own = F.size("embedding") == width
        found = _of_one_width(rows.where(own), asked.where(own), width, k, trees, leaf, leaves, sample, seed)
        out = found if n == 0 else out.unionByName(found)
    return out


def _of_one_width(rows: DataFrame, queries: DataFrame, width: int, k: int, trees: int, leaf: int, leaves: int | None, sample: int, seed: int) -> DataFrame:
    spark = rows.sparkSession

    def packed(column):  # little-endian doubles
        return column.mapInArrow(_pack, "rep long, ids array<long>, v binary")

    few = Window.partitionBy("embedding").orderBy("vec_id")
    kept = rows.distinct().withColumn("n", F.row_number().over(few)).where(F.col("n") <= k + 1)
    groups = kept.groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.array_sort(F.collect_list("vec_id")).alias("ids"))  # k + 1 ids at most
    groups = checkpointed(groups)
    total = groups.count()
    bound = int(min(1.0, sample / max(total, 1)) * (1 << 30))
    fitted = groups.where(F.pmod(F.xxhash64("rep"), F.lit(1 << 30)) < bound).orderBy("rep").select("embedding").collect()  # a bounded sample
    grown = Forest(np.array([r[0] for r in fitted], np.float64).reshape(-1, width), trees, leaf, seed)
    leaves = grown.opened() if leaves is None else leaves
    forest = spark.sparkContext.broadcast(grown)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                vs, ids = part.column(2).to_pylist(), part.column(0).to_pylist()
                places = forest.value.place(_matrix(part.column(2)))
                for t in range(places.shape[1]):
                    yield _leaf_rows(forest, [(t, int(p)) for p in places[:, t]], ids, vs, True)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, v in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                found = forest.value.search(np.frombuffer(v, "<f8"), leaves)
                yield _leaf_rows(forest, found, [i] * len(found), [v] * len(found), False)

    wanted = queries.distinct().join(groups.select("embedding", "rep"), "embedding").select(F.col("vec_id").alias("query_id"), "rep")
    wanted = checkpointed(wanted)
    asked = groups.join(wanted.select("rep").distinct(), "rep", "left_semi")
    columns = ("rep", "ids", "embedding")
    leaf_schema = "unit long, member boolean, rep long, v binary"
    met = packed(groups.select(*columns)).mapInArrow(index, leaf_schema).unionByName(packed(asked.select(*columns)).mapInArrow(ask, leaf_schema))
    met = met.repartition("unit").sortWithinPartitions("unit", "member")
    found = met.mapInArrow(lambda it: _compare(it, k + 1), "q long, rep long, score double")
    best = found.groupBy("q", "rep").agg(F.max("score").alias("score"))
    best = best.withColumn("n", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "rep"))).where(F.col("n") <= k + 1)
    best = best.join(groups.select("rep", "ids"), "rep").select("q", F.explode("ids").alias("vec_id"), "score")
    lists = best.groupBy("q").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("far"), "vec_id"))).alias("found"))  # (k + 1)^2 at most
    own = wanted.join(lists, F.col("rep") == F.col("q")).select("query_id", F.slice(F.filter("found", lambda x: x["vec_id"] != F.col("query_id")), 1, k).alias("found"))
    out = own.select("query_id", F.posexplode("found").alias("i", "x"))
    return out.select("query_id", (F.col("i") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.far")).alias("score"))


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(2)
        flat = lists.flatten().to_numpy().astype("<f8")
        at = (lists.offsets.to_numpy() - lists.offsets[0].as_py()).tolist()
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([flat[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())], ["rep", "ids", "v"])
