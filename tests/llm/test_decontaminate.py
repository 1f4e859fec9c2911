"""Block-max WAND against scoring every item; leaks against a plain search."""

import random

import numpy as np
import pyarrow as pa

from tapewell.llm import decontaminate as dc

SF = "/root/testdata/sf0.01"


def test_search_equals_full_scoring(monkeypatch):
    monkeypatch.setattr(dc, "POSTINGS", 3)
    rng = random.Random(1)
    vocabulary = [f"t{k}" for k in range(60)]
    items = [(i, " ".join(rng.choice(vocabulary[: rng.choice((6, 60))]) for _ in range(rng.randint(1, 25)))) for i in range(200)]
    index = dc.build(items)
    weight = np.zeros((len(items), len(index.terms)))
    for t, (own, impact, _) in enumerate(index.lists):
        weight[own, t] = impact
    assert np.allclose(weight.sum(axis=1), 1)
    for _ in range(200):
        terms = rng.sample(range(len(index.terms)), rng.randint(0, 40))
        for threshold in (0.2, 0.5, 0.9):
            got = dict(dc.search(index, terms, threshold))
            score = weight[:, terms].sum(axis=1)
            want = set(np.flatnonzero(score >= threshold + 1e-9))
            assert want <= set(got) <= set(np.flatnonzero(score >= threshold - 1e-9))
            assert all(abs(got[i] - score[i]) < 1e-9 for i in got)


def test_whole_table_equals_a_plain_search(spark):
    docs, bench = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    got = {(r.doc_id, r.item_id) for r in dc.leaks(docs, bench).collect()}
    plain = lambda t: " " + " ".join("".join(c.lower() if c.isalnum() else " " for c in t).split()) + " "
    items = [(r.item_id, plain(r.text)) for r in bench.collect()]
    want = {(r.doc_id, i) for r in docs.collect() for i, t in items if t in plain(r.text)}
    assert want and got == want
    assert {r.doc_id for r in dc.clean(docs, bench).collect()} == {r.doc_id for r in docs.collect()} - {d for d, _ in want}


def test_edits_blocks_and_odd_rows(spark, monkeypatch):
    question, answer = "Which of the two rivers in the old story runs past the mill and under the bridge?", "The grey river runs there, says the miller."
    item = f"{question}\n{answer}"
    filler = " ".join(f"w{k}" for k in range(150))
    rows = [(1, f"{filler} {item.upper()} {filler}"), (2, f"{filler} {question} {filler}"), (3, answer), (4, None), (5, ""), (None, item), (1, f"{filler} {item.upper()} {filler}"),
            (6, item.replace("old", "very old")), (7, filler)]
    docs = spark.createDataFrame([(i, t, 1.0) for i, t in rows], "doc_id long, text string, score double")
    bench = spark.createDataFrame([(10, item), (11, "some other item of words that are not found in any text here"), (None, "x"), (12, None), (13, ""), (10, item)], "item_id long, text string")
    want = [(1, 10), (1, 10), (6, 10), (None, 10)]
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted(((r.doc_id, r.item_id) for r in dc.leaks(docs, bench).collect()), key=key) == want
    monkeypatch.setattr(dc, "INDEX_ITEMS", 1)
    monkeypatch.setattr(dc, "GROUP_BYTES", 100)
    assert sorted(((r.doc_id, r.item_id) for r in dc.leaks(docs, bench).collect()), key=key) == want
    assert sorted(r.doc_id for r in dc.clean(docs, bench).collect()) == [2, 3, 4, 5, 7]
    assert dc.leaks(docs.where("false"), bench).count() == 0
    assert dc.clean(docs, bench.where("false")).count() == len(rows)


def test_one_changed_word_of_a_short_answer(spark):
    question = "Which colour do the old tables of the harbour office give for the hull of the ferry?"
    answers = ["gray", "light gray", "pale light gray", "a pale light gray", "a pale light gray stripe", "one pale light gray stripe below deck", "one very pale light gray stripe below the deck"]
    items = [(i, f"{question}\n{a}") for i, a in enumerate(answers)]
    filler = " ".join(f"w{k}" for k in range(150))
    docs = [(100 * i + k, f"{filler} {question} {' '.join('changed' if j == k else w for j, w in enumerate(a.split()))} {filler}") for i, a in enumerate(answers) for k in range(len(a.split()))]
    found = {(r.doc_id, r.item_id) for r in dc.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert all((d, d // 100) in found for d, _ in docs if d >= 100)
    assert (0, 0) not in found  # nothing of a one-word answer is left
    plain = spark.createDataFrame([(1, f"{filler} {question} {filler}"), (2, f"{filler} pale light gray stripe below {filler}")], "doc_id long, text string")
    assert dc.leaks(plain, spark.createDataFrame(items, "item_id long, text string")).count() == 0


def test_question_and_answer():
    assert dc.split_item("a b?\nc d.") == ("a b?", "\nc d.")
    assert dc.split_item("a b. c d.") == ("a b. ", "c d.")
    assert dc.split_item("a b") == ("a b", "")
    assert len(dc.terms_of(pa.array(["don't É1", None])).key) == 3
