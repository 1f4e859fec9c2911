"""FM-index dedup against a scan of all windows."""

import random

import numpy as np
import pytest

from tapewell.llm import substring
from tapewell.llm.substring import WINDOW, FMIndex, WaveletMatrix


def brute(rows, words):
    first = {}
    split = [(i, words(t or "")) for i, t in rows]
    for i, w in split:
        for s in range(len(w) - 19):
            k, at = tuple(w[s : s + 20]), (i, s)
            first[k] = min(first.get(k, at), at)
    out = []
    for i, w in split:
        gone = set()
        for s in range(len(w) - 19):
            if first[tuple(w[s : s + 20])] < (i, s):
                gone.update(range(s, s + 20))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out)


def test_rank():
    rng = np.random.default_rng(1)
    text = rng.integers(0, 256, 1000).astype(np.uint8)
    wm = WaveletMatrix(text)
    sym, at = rng.integers(0, 256, 500), rng.integers(0, 1001, 500)
    assert wm.rank(sym, at).tolist() == [int((text[:a] == s).sum()) for s, a in zip(sym, at, strict=True)]


def test_windows_of_texts_outside_the_index():
    rng = np.random.default_rng(2)
    text = rng.integers(1, 4, 3000).astype(np.uint8)
    other = np.concatenate([text[100:160], rng.integers(1, 4, 30), text[500:540], [9, 9]]).astype(np.uint8)
    low, high = FMIndex(text).windows(other, np.array([0, 70]), np.array([70, len(other)]))
    raw = text.tobytes()
    for b, e in ((0, 70), (70, len(other))):
        for s in range(b, e - WINDOW + 1):
            key = other[s : s + WINDOW].tobytes()
            assert high[s] - low[s] == sum(raw.startswith(key, k) for k in range(len(raw)))


def test_whole_table(spark, words):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = sorted(tuple(r) for r in substring.dedup(docs).collect())
    assert got == brute(rows, words)
    assert sum(r[2] for r in got) > 1000


@pytest.mark.parametrize("hot", [4096, 3])
def test_odd_rows(spark, words, monkeypatch, hot):
    monkeypatch.setattr(substring, "HOT", hot)
    rng = random.Random(4)
    passage = " ".join(f"p{k}" for k in range(35))
    rows = [(i, " ".join(f"w{rng.randrange(10**6)}" for _ in range(rng.randint(0, 30))) + "\n" + passage + " \t" + f"end{i} é") for i in range(40)]
    rows += [(50, ""), (51, None), (52, "a " * 100), (53, "a " * 25), (54, "A " * 25), (55, passage), (55, passage), (56, "x " + passage), (57, "one\x0btwo three " * 12)]
    rows += [(60, "q0 " + passage), (60, passage + " " + passage)]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, n_words int")
    got = sorted(tuple(r) for r in substring.dedup(df.repartition(6)).collect())
    assert got == brute(rows, words)


def test_null_ids_and_empty_table(spark):
    passage = " ".join(f"p{k}" for k in range(30))
    df = spark.createDataFrame([(None, passage), (1, passage)], "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in substring.dedup(df).collect()} == {1: 0, None: 30}
    assert substring.dedup(df.where("false")).count() == 0
