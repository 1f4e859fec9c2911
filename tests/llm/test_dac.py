"""Token files against the public library, and random access against the whole stream."""

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tapewell.llm import dac

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def ids_of():
    t = Tokenizer.from_file(WORD_BPE)
    return lambda texts: [[*e.ids, 1] for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def kept(spark, docs, path, segment=dac.SEGMENT):
    dac.write(docs, WORD_BPE, str(path), segment=segment)
    return dac.read_segments(spark, str(path))


def rows_of(files, segment=dac.SEGMENT):
    return sorted(((r.start, r.doc_id, np.frombuffer(r.ids, "<u4").tolist()) for r in dac.read(files, segment).collect()), key=lambda r: r[0])


def test_codes_of_all_sizes():
    rng = np.random.default_rng(3)
    ids = np.concatenate([rng.integers(0, 1 << k, 5_000) for k in (3, 8, 9, 16, 17, 24, 32)]).astype(np.uint32)
    rng.shuffle(ids)
    for part in (ids, ids[:1], ids[:64], ids[:65], ids[:0], np.zeros(70_000, np.uint32), np.full(140_000, 0xFFFFFFFF, np.uint32)):
        file = dac.TokenFile.from_bytes(dac.TokenFile.encode(part).to_bytes())
        assert file.size == len(part) and (file.slice(0, file.size) == part).all()
        if len(part):
            at = rng.integers(0, len(part), 300)
            assert (file.at(at) == part[at]).all()
    with pytest.raises(ValueError):
        dac.TokenFile.from_bytes(b"none")


@pytest.mark.parametrize("segment", [dac.SEGMENT, 1_000])
def test_whole_table(spark, tmp_path, ids_of, segment):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    given = sorted((r.doc_id, r.text) for r in docs.collect())
    want, at = [], 0
    for (doc, _), ids in zip(given, ids_of([t for _, t in given]), strict=True):
        want.append((at, doc, ids))
        at += len(ids)
    files = kept(spark, docs.repartition(5), tmp_path / "files", segment)
    assert rows_of(files, segment) == want
    stream = [i for _, _, ids in want for i in ids]
    places = [0, 1, 999, 1000, 1001, len(stream) - 1, len(stream) // 2, 5, 5, len(stream), -1, None]
    wanted = spark.createDataFrame([(p, k) for k, p in enumerate(places)], "position long, id long")
    got = sorted(((r.position, r.id) for r in dac.fetch(files, wanted, segment).collect()), key=str)
    assert got == sorted(((p, stream[p] if p is not None and 0 <= p < len(stream) else None) for p in places), key=str)


def test_odd_rows(spark, tmp_path, ids_of):
    texts = [(3, "a  b C d́ é ́x", 1.0), (3, None, 2.0), (None, "It's <|endoftext|>THEY'LL<|startoftext|> x<|endoftext|>", 0.0), (None, None, 0.0), (1, "", 0.0),
             (2, " \n\t\r\x0b\x0c ", 0.0), (5, "ΑΣ İI ß \U0001f642 123 4½ ﬁ", 0.0), (6, "word " * 5_000, 0.0), (7, "x" * 3_000, 0.0), (-4, "\x1c\x85 a", 0.0), (3, "tie", 0.0), (8, "same", 0.0), (8, "same", 0.0)]
    docs = spark.createDataFrame(texts, "doc_id long, text string, start double")
    rows = rows_of(kept(spark, docs.repartition(3), tmp_path / "files", 64), 64)
    want = sorted(((i, ids) for (i, _, _), ids in zip(texts, ids_of([t for _, t, _ in texts]), strict=True)), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert sorted(((i, ids) for _, i, ids in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1])) == want
    assert [s for s, _, _ in rows] == np.cumsum([0, *(len(ids) for _, _, ids in rows)])[:-1].tolist()
    order = [i for _, i, _ in rows]
    assert order == sorted(order, key=lambda i: (i is not None, i or 0))


def test_empty_table(spark, tmp_path):
    files = kept(spark, spark.createDataFrame([], "doc_id long, text string"), tmp_path / "files")
    assert dac.read(files).count() == 0
    assert [r.id for r in dac.fetch(files, spark.createDataFrame([(0,)], "position long")).collect()] == [None]
