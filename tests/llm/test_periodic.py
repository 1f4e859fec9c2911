"""Runs against a scan of every period."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from tapewell.llm import periodic, q_periodic


def brute(w):
    """For each period: maximal stretches where words q apart are equal, kept if q is the stretch's smallest period."""
    out = []
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            s, n = i, j + q - i
            if n >= max(12, 2 * q) and not any(all(w[x] == w[x + d] for x in range(s, s + n - d)) for d in range(1, q)):
                out.append((s, n, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def fibonacci(n):
    a, b = "a", "ab"
    while len(b) < n:
        a, b = b, b + a
    return list(b[:n])


def odd_texts():
    rng = random.Random(4)
    texts = [None, "", " \n ", "a", "a " * 11, "a " * 12, "a\tb " * 5, "a b " * 6, "x " + "a b c " * 4 + "a", "a b c d e f g " * 2, "a b c d e f " * 2, " ".join(fibonacci(200)), "a " * 3000]
    for size, letters in ((30, 2), (60, 2), (120, 3), (200, 2)):
        texts += [" ".join(rng.choice("abcdef"[:letters]) for _ in range(size)) for _ in range(15)]
    for _ in range(30):
        base = [rng.choice("abcdefgh") for _ in range(rng.randint(1, 30))]
        texts.append(" ".join(rng.choices("xyz", k=rng.randint(0, 9)) + (base * 9)[: rng.randint(8, 90)] + rng.choices("xyz", k=rng.randint(0, 9)) + base * rng.randint(0, 3)))
    line = [f"w{k}" for k in range(14)]
    texts.append(" ".join(x for k in range(300) for x in [*line, *([f"n{k}"] if k % 3 else [])]))
    return texts


@pytest.mark.parametrize("group", [1, 7, 1000])
def test_runs_of_odd_texts(spark, words, group):
    texts = odd_texts()
    docs = spark.createDataFrame([(k if k % 5 else None, t, "n", 0) for k, t in enumerate(texts)], "doc_id long, text string, runs string, n_words int")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", group)
    try:
        rows = periodic.runs(docs.coalesce(1)).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for k, (t, r) in enumerate(zip(texts, rows, strict=True)):
        w = words(t or "")
        want = brute(w)
        assert [(x.start, x.length, x.period) for x in r.runs] == want, k
        assert (r.doc_id, r.n_words, r.collapsed) == (k if k % 5 else None, len(w), collapsed(w, want))
    assert sum(len(r.runs) for r in rows) > 100


def test_whole_table(spark, words):
    out = {r.doc_id: r for r in q_periodic.op13_periodic_runs(spark, "/root/testdata/sf0.001").collect()}
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    assert len(out) == len(docs)
    seen = 0
    for d in docs:
        w = words(d.text or "")
        h = zlib.crc32(str(d.doc_id).encode())
        if h % 10 == 0 and w:
            a = h // 10 % len(w)
            p = 1 + (len(w) - a) // (3 + h // 10 % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
        want = brute(w) if len(w) < 1500 else fast(w)
        r = out[d.doc_id]
        assert r.n_runs == len(want)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in want).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(collapsed(w, want).encode()).hexdigest()
        best = min(((-n, s, q) for s, n, q in want), default=None)
        assert (r.start, r.length, r.period, r.exponent_milli) == ((best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else (None,) * 4)
        seen += len(want)
    assert seen


def fast(w):
    """``brute`` with one array comparison per period."""
    ids = {x: k for k, x in enumerate(dict.fromkeys(w))}
    x = np.array([ids[v] for v in w])
    out = []
    for q in range(1, len(x) // 2 + 1):
        same = np.concatenate([[False], x[:-q] == x[q:], [False]])
        edge = np.flatnonzero(same[1:] != same[:-1])
        for s, e in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            n = e - s + q
            if n >= max(12, 2 * q) and not any((x[s : s + n - d] == x[s + d : s + n]).all() for d in range(1, q)):
                out.append((s, n, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_empty_table(spark):
    assert periodic.runs(spark.createDataFrame([], "doc_id long, text string")).count() == 0
