"""The pipeline against brute-force versions of its stages."""

import sys
from pathlib import Path

import numpy as np
import pytest
from tests_llm_brute import components_of, secrets_of
from tokenizers import Tokenizer

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline as cp  # noqa: E402
from tapewell.llm import quality  # noqa: E402

SF = "/root/testdata/sf0.01"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_run_equals_brute_force(spark, words):
    docs, labels, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels", "benchmark"))
    good = {r.doc_id for r in quality.classify(docs, labels).where("score >= 0.7").collect()}
    rows = {r.doc_id: r for r in docs.collect() if r.doc_id in good}
    parts = components_of([(i, r.text) for i, r in rows.items()], words, 5, 80)
    rows = {i: r for i, r in rows.items() if parts[i][1] == i}
    plain = lambda t: " " + " ".join("".join(c.lower() if c.isalnum() else " " for c in t).split()) + " "
    items = [plain(r.text) for r in bench.collect()]
    rows = {i: r for i, r in rows.items() if not any(t in plain(r.text) for t in items)}
    _, texts = secrets_of([(i, r.text, r.source) for i, r in rows.items()])
    public = Tokenizer.from_file(cp.TOKENIZER)
    want = {i: public.encode(texts[i], add_special_tokens=False).ids for i in rows}
    out = cp.run(spark, SF).collect()
    assert len(out) == len(want) and {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in out} == want
    assert all(r.n_tokens == len(want[r.doc_id]) and (r.lang, r.source) == (rows[r.doc_id].lang, rows[r.doc_id].source) for r in out)
    assert 0 < len(want) < len(good) < docs.count()


@pytest.mark.parametrize("stage", [s for _, s in cp.STAGES[:-1]])
def test_stages_keep_the_columns_and_take_odd_rows(spark, stage):
    rows = [(None, None, None, None, None), (1, "", "en", "a", 0), (2, "of the and to", "en", None, 13), (2, "of the and to", "en", None, 13), (3, "x " * 5000, None, "b", 10000)]
    df = spark.createDataFrame([(*r, "extra") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, score string")
    out = stage(spark, df, SF)
    assert out.columns == [*COLUMNS, "score"] and out.count() <= len(rows)
    assert stage(spark, df.where("false"), SF).count() == 0
