"""Recall and exact scores against brute force."""

import math

import numpy as np
from pyspark.sql import functions as F

from tapewell.llm import ann, q_ann


def brute(rows, k=5):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], np.float64)
    out = {}
    for q in range(len(ids)):
        if ids[q] % 50 == 0:
            s = (x * x[q]).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((x[q] * x[q]).sum()))
            out[int(ids[q])] = sorted((-float(s[j]), int(ids[j])) for j in range(len(ids)) if j != q)[:k]
    return out


def test_recall_on_the_table(spark):
    sf = "/root/testdata/sf0.1"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want = brute(rows)
    got = {}
    for r in q_ann.op6_nearest_neighbours(spark, sf).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    assert got.keys() == want.keys()
    hits = sum(len({v for v, _ in got[q].values()} & {v for _, v in want[q]}) for q in want)
    assert hits / sum(len(w) for w in want.values()) >= 0.95
    for q, found in got.items():
        assert sorted(found) == list(range(1, len(found) + 1))
        assert [found[r] for r in sorted(found)] == sorted(found.values(), key=lambda f: (-f[1], f[0]))


def test_recall_on_a_larger_table(spark):
    """20,000 rows derived from the given table: the centre of each row's label ten times, moved by noise of the table's spread."""
    given = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    kept = given.collect()
    x, label = np.array([r.embedding for r in kept], np.float64), np.array([r.label for r in kept])
    centre = {v: x[label == v].mean(axis=0) for v in np.unique(label).tolist()}
    spread = math.sqrt(np.mean([x[label == v].var(axis=0).mean() for v in centre]))
    centres = spark.createDataFrame([(v, c.tolist()) for v, c in centre.items()], f"label {given.schema['label'].dataType.simpleString()}, centre array<double>")
    draw = lambda i, side: (F.pmod(F.xxhash64("vec_id", "copy", i, F.lit(side)), F.lit(1 << 30)) + 0.5) / float(1 << 30)
    noise = lambda i: F.sqrt(-2 * F.log(draw(i, 0))) * F.cos(2 * math.pi * draw(i, 1))
    many = given.join(centres, "label").crossJoin(spark.range(10).withColumnRenamed("id", "copy"))
    many = many.select((F.col("vec_id") * 10 + F.col("copy")).alias("vec_id"), F.transform("centre", lambda c, i: c + spread * noise(i)).alias("embedding"))
    rows = many.collect()
    assert len(rows) == 20_000
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    got = {}
    for r in ann.neighbours(many, many.where("vec_id % 400 = 0")).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = 0
    for q in np.flatnonzero(ids % 400 == 0):
        score = x @ x[q]
        score[q] = -2
        hits += len(got[ids[q]] & set(ids[np.argsort(-score)[:5]].tolist()))
    assert len(got) == 50 and hits / (5 * len(got)) >= 0.95


def test_opened_leaves_grow_with_the_forest():
    x = np.random.default_rng(1).normal(size=(16_384, 8))
    small, large = (ann.Forest(x[:n], ann.TREES, ann.LEAF, 6) for n in (4_096, 16_384))
    assert large.opened() == 4 * small.opened() == 1024
    assert ann.Forest(x[:50], ann.TREES, ann.LEAF, 6).opened() == ann.LEAVES


def test_odd_rows(spark):
    rng = np.random.default_rng(1)
    same = [1.0, 2.0, 0.0, -1.0]
    rows = [(i, [float(v) for v in rng.normal(size=4)]) for i in range(1, 60)]
    rows += [(i, same) for i in range(100, 160)]
    bad = [(None, same), (200, None), (250, []), (300, [0.0] * 4), (350, [1.0, math.nan, 0.0, 0.0]), (400, [1.0, math.inf, 0.0, 0.0]), (450, [1.0, None, 0.0, 0.0]), (500, [1.0, 2.0])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows + bad + [(100, same)]], "vec_id long, embedding array<float>, rank int")
    clean = [(i, np.float32(v).astype(float).tolist()) for i, v in rows]
    got = {}
    for r in ann.neighbours(df, df.where("vec_id % 50 = 0"), leaves=10**6).collect():
        got.setdefault(r.query_id, []).append((r.rank, -r.score, r.vec_id))
    want = brute(clean)
    assert got.keys() == want.keys()
    for q, w in want.items():
        assert [v for _, _, v in sorted(got[q])] == [v for _, v in w]
        assert np.allclose([s for _, s, _ in sorted(got[q])], [s for s, _ in w], atol=1e-15, rtol=0)
    one = df.where("vec_id = 100")
    assert ann.neighbours(one, one).count() == 0
    assert ann.neighbours(df.where("false"), df.where("false")).count() == 0


def test_vectors_of_each_length_are_searched(spark):
    rng = np.random.default_rng(1)
    rows = [(k, rng.normal(size=8).tolist()) for k in range(100)] + [(k, rng.normal(size=9).tolist()) for k in range(100, 130)] + [(150, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in ann.neighbours(df, df.where("vec_id % 50 = 0")).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id))
    assert {q: len(f) for q, f in got.items()} == {0: 5, 50: 5, 100: 5}
    for q, found in got.items():
        own = [(i, np.array(v)) for i, v in rows if len(v) == len(rows[q][1]) and i != q]
        v = np.array(rows[q][1])
        near = sorted(own, key=lambda x: (-(x[1] @ v) / np.linalg.norm(x[1]), x[0]))[:5]
        assert [i for _, i in sorted(found)] == [i for i, _ in near]
