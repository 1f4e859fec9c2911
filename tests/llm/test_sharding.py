"""The external shuffle: law, completeness, order."""

import zlib
from collections import Counter

import numpy as np

from tapewell.llm import q_sharding, sharding


def check_law(rows, shards=8):
    counts = Counter(r.shard for r in rows)
    if len(rows) >= shards:
        assert set(counts) == set(range(shards))
    assert not counts or max(counts.values()) - min(counts.get(k, 0) for k in range(shards)) <= 1
    for k in range(shards):
        assert sorted(r.slot for r in rows if r.shard == k) == list(range(counts.get(k, 0)))


def test_query_on_whole_table(spark):
    rows = q_sharding.op5_external_shuffle(spark, "/root/testdata/sf0.01").collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    check_law(rows)
    for r in rows:
        raw = docs[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "rows", None)


def test_order_is_seeded_and_looks_random(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    place = lambda df, **o: {r.doc_id: r.place for r in sharding.external_shuffle(df, bucket_bytes=400_000, **o).select("doc_id", "place").collect()}
    a, b, c = place(docs), place(docs.repartition(5)), place(docs, seed=21)
    assert a == b and a != c
    ids = sorted(a)
    assert sorted(a.values()) == list(range(len(ids)))
    for p in (a, c):
        assert abs(np.corrcoef(ids, [p[i] for i in ids])[0, 1]) < 0.1
        assert sum(p[i + 1] == p[i] + 1 for i in ids[:-1]) < 8


def test_odd_rows(spark):
    rows = [(None, None, 5, 1), (None, "", 5, 2), (1, "a", 6, 3), (1, "a", 6, 3), (1, "a", 6, 3), (2, "x" * 300_000, 7, 4), (3, "", 7, 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard int, `n.b` int")
    out = sharding.external_shuffle(df, bucket_bytes=1000)
    got = out.collect()
    check_law(got)
    assert sorted((r["n.b"] for r in got)) == [1, 2, 3, 3, 3, 4, 5]
    assert sharding.external_shuffle(df.where("false")).count() == 0


def test_written_shards(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    sharding.write_shards(docs, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.select(docs.columns).exceptAll(docs).count() == 0 and back.count() == docs.count()
    check_law(back.collect())


def test_columns_of_any_name_and_type(spark):
    names = ["_hash", "_b", "_i", "_offset", "r", "n", "rs", "hash", "doc", "of", "i"]
    rows = [(k if k % 4 else None, f"t{k % 5}", {"a": k, "b": None} if k % 3 else None, *["mine"] * len(names)) for k in range(30)]
    df = spark.createDataFrame(rows, ", ".join(["doc_id long", "text string", "m map<string,int>", *[f"{n} string" for n in names]]))
    out = sharding.external_shuffle(df, bucket_bytes=20).collect()
    assert sorted(r.place for r in out) == list(range(30))
    assert sorted((r.doc_id, r.text, r.m) for r in out if r.doc_id) == sorted(r[:3] for r in rows if r[0])
    assert {r[n] for r in out for n in names} == {"mine"}
