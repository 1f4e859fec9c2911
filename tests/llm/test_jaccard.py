"""The token-group join against all pairs."""

import random

import pytest
from tests_llm_brute import components_of

from tapewell.llm import jaccard
from tapewell.llm.components import components


def brute(rows, words, n, percent):
    return {(i, *found) for i, found in components_of(rows, words, n, percent).items()}


@pytest.mark.parametrize(("n", "percent"), [(4, 85), (5, 80)])
def test_whole_table(spark, words, n, percent):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = {tuple(r) for r in jaccard.join(docs, n, percent).collect()}
    want = brute(rows, words, n, percent)
    assert got == want
    assert sum(r[0] != r[2] for r in want) > 20


def test_near_copies_shared_lines_and_odd_rows(spark, words, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 8)
    rng = random.Random(5)
    base = [f"w{k}" for k in range(60)]
    line = "one line that very many of these texts have in common with each other "
    rows = []
    for i in range(120):
        t = list(base)
        for _ in range(rng.randint(0, 4)):
            t[rng.randrange(60)] = f"x{rng.randrange(1000)}"
        rows.append((1000 - i, " ".join(t)))
    rows += [(2000 + i, line + " ".join(f"y{rng.randrange(10**6)}" for _ in range(rng.randint(3, 40)))) for i in range(80)]
    rows += [(3000, ""), (3001, "  \n"), (3002, "a b"), (3003, "A B"), (3004, "a b c"), (3005, None), (3006, "a b"), (3007, "É b"), (3008, "é b")]
    df = spark.createDataFrame([(i, t, "n", 1) for i, t in rows], "doc_id long, text string, component_id string, n int")
    got = {tuple(r) for r in jaccard.join(df.repartition(5)).collect()}
    assert got == brute(rows, words, 4, 85)


def test_null_ids_repeated_rows_and_empty_table(spark):
    df = spark.createDataFrame([(None, "a b c d e"), (7, "a b c d e"), (7, "a b c d e"), (9, "A b c d e"), (None, None)], "doc_id long, text string")
    rows = sorted((tuple(r) for r in jaccard.join(df).collect()), key=repr)
    assert {r[:3] for r in rows} == {(7, 2, 7), (9, 2, 7), (None, 2, None), (None, 0, None)} and len(rows) == 5
    kept = sorted((r.doc_id or 0, r.text) for r in jaccard.keep_one(df).collect() if r.doc_id)
    assert kept == [(7, "a b c d e")]
    assert jaccard.keep_one(df).where("doc_id is null").count() == 2
    assert jaccard.join(df.where("false")).count() == 0


def test_components_of_a_long_chain(spark):
    ids = list(range(200))
    random.Random(2).shuffle(ids)
    df = spark.createDataFrame([(a, b) for a, b in zip(ids, ids[1:])] + [(500, 500), (None, 3), (601, 600)], "a long, b long")
    got = {r.id: r.component for r in components(df).collect()}
    assert got == {i: 0 for i in range(200)} | {600: 600, 601: 600}
