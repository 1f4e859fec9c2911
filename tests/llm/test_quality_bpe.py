"""Quality scores against held-out labels; token ids against the public library."""

import random
import tracemalloc

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from tapewell.llm import bpe, quality

SF = "/root/testdata/sf0.01"
BPE = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_held_out_labels_are_told_apart(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    rows = quality.classify(docs.select("doc_id", "text"), labels).join(labels, "doc_id").where("held_out").collect()
    assert rows and {r.held_out for r in rows} == {True}
    assert sum(r.predicted == r.quality for r in rows) / len(rows) > 0.97
    good, bad = [r.score for r in rows if r.quality], [r.score for r in rows if not r.quality]
    assert np.mean(np.array(good)[:, None] > np.array(bad)) > 0.99


def test_quality_takes_odd_rows(spark):
    odd = spark.createDataFrame([(1, None, 5.0), (1, None, 5.0), (None, "of the", 1.0), (3, "", 2.0), (4, "the " * 50_000, 0.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(None, 1, 0), (1, 1, 0), (1, 0, 0), (9, None, 0)], "doc_id long, quality int, toxic int")
    rows = quality.classify(odd, labels).collect()
    assert len(rows) == 5 and all(0 <= r.score <= 1 for r in rows)
    none = quality.classify(odd, labels.where("false")).collect()
    assert all(r.predicted == 1 for r in none)
    assert quality.classify(odd.where("false"), labels).count() == 0


def test_scores_are_the_same_for_any_partitioning(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    a = {r.doc_id: r.score for r in quality.classify(docs, labels).select("doc_id", "score").collect()}
    b = {r.doc_id: r.score for r in quality.classify(docs.repartition(7), labels.repartition(3)).select("doc_id", "score").collect()}
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-9 for k in a)


def test_training_holds_its_rows_once():
    """Before: rows as Python bytes and, beside them, as 64-bit arrays, 3 times the batch; 35 MB more than an executor has in the pipeline's check."""
    rng = np.random.default_rng(3)
    rows = [(int(y), np.unique(rng.integers(0, quality.DIM, 4_000)).astype("<i4")) for y in rng.integers(0, 2, 600)]
    rows = [(y, s, rng.random(len(s)).astype("<f4") / len(s)) for y, s in rows] + [(1, np.zeros(0, "<i4"), np.zeros(0, "<f4"))]
    batch = pa.RecordBatch.from_arrays([pa.array([y for y, _, _ in rows]), pa.array([s.tobytes() for _, s, _ in rows]), pa.array([v.tobytes() for _, _, v in rows])], ["y", "slots", "values"])
    tracemalloc.start()
    got = quality.learn([batch.slice(0, 250), batch.slice(250)])
    held = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.array_equal(got, quality.ftrl(rows)) and quality.learn([]) is None
    assert held < 0.75 * batch.nbytes + 8 * 8 * quality.DIM  # the model's own arrays


@pytest.fixture(scope="module")
def public():
    return Tokenizer.from_file(BPE)


def test_ids_of_whole_texts(spark, public):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = bpe.decode(bpe.encode(docs, BPE), BPE).collect()
    ids = [e.ids for e in public.encode_batch([r.text for r in rows], add_special_tokens=False)]
    for r, own in zip(rows, ids, strict=True):
        assert np.frombuffer(r.ids, "<u4").tolist() == own
        assert r.decoded == r.text


def test_odd_texts(spark, public):
    rng = random.Random(3)
    texts = ["", " ", "\n\n x", "aaaaaaaaaaa" * 30, "a" * 50_000, "<|endoftext|>", "x<|endoftext|> y<|endoftext|>", "\x1c\x85　a", "don't WE'LL '", "éé漢字🙂" * 20]
    texts += ["".join(rng.choice("ab  'sé1!\n") for _ in range(rng.randint(1, 40))) for _ in range(300)]
    rows = bpe.decode(bpe.encode(spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None])], "doc_id long, text string"), BPE), BPE).orderBy("doc_id").collect()
    for r, t in zip(rows, [*texts, ""], strict=True):
        own = public.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(r.ids, "<u4").tolist() == own, t[:50]
        assert r.decoded == public.decode(own, skip_special_tokens=False)
    assert bpe.encode(spark.createDataFrame([], T._parse_datatype_string(DOCS)), BPE).count() == 0


def test_a_clashing_column_is_replaced(spark):
    df = spark.createDataFrame([(1, "the", "x")], "doc_id long, text string, ids string")
    assert bpe.encode(df, BPE).select(F.octet_length("ids")).first()[0] == 4
