"""Severity against held-out labels, and the ordinal model's shape."""

import numpy as np

from tapewell.llm import toxicity

SF = "/root/testdata/sf0.1"


def test_held_out_labels_are_told_apart(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{SF}/labels.parquet").withColumnRenamed("toxic", "label")
    rows = toxicity.severity(docs, labels.withColumnRenamed("label", "toxic")).join(labels, "doc_id").where("crc32(cast(doc_id as string)) % 4 = 2").collect()
    bad, good = [r for r in rows if r.label], [r for r in rows if not r.label]
    assert len(bad) > 50
    assert np.mean([r.toxic for r in bad]) > 0.8 and np.mean([r.toxic for r in good]) < 0.01
    assert {r.grade for r in rows} == {0, 1, 2}
    assert all(0 <= r.expected_severity <= 2 for r in rows)
    assert min(np.mean([r.expected_severity for r in rows if r.grade == k + 1]) - np.mean([r.expected_severity for r in rows if r.grade == k]) for k in (0, 1)) > 0.3


def test_grades_and_weights():
    rng = np.random.default_rng(1)
    rows = []
    for k in range(300):
        n = (0, 1, 4)[k % 3]
        rows.append((int(n > 0), np.concatenate([rng.choice(10, n, replace=False), 10 + rng.choice(200, 30, replace=False)])))
    grade = toxicity.grades(rows, 210)
    assert {g for g, (y, _) in zip(grade, rows, strict=True) if not y} == {0}
    assert np.mean([g for k, g in enumerate(grade) if k % 3 == 2]) > np.mean([g for k, g in enumerate(grade) if k % 3 == 1])
    w, cut = toxicity.fit(rows, 210)
    assert cut[0] < cut[1] and w[:10].min() > np.abs(w[10:]).mean()


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, None, 5), (1, None, 5), (None, "you idiot", 1), (3, "", 2), (4, "the " * 50_000, 0)], "doc_id long, text string, grade int")
    labels = spark.createDataFrame([(None, 1, 0), (1, 1, 0), (4, 0, 1), (4, 0, 0), (9, None, None)], "doc_id long, quality int, toxic int")
    assert toxicity.severity(df, labels).count() == 5
    none = toxicity.severity(df, labels.where("false")).collect()
    assert {(r.grade, r.toxic) for r in none} == {(0, 0)}
    assert toxicity.severity(df.where("false"), labels).count() == 0
