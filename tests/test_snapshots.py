"""Upserts touch their buckets only, a lost job changes nothing, digests add up, manifests are observed."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tapewell.operators.health import table_digest
from tapewell.sources import sinks, snapshots

COLUMNS = ["id", "ticker", "v"]


def merge(old, new):
    return sinks.merge_latest(old, new, ["id"])


def folders(spark, path, version=None):
    return {r.bucket: r.folder for r in snapshots.snapshot(spark, path, version).collect()}


@pytest.fixture
def table(spark, tmp_path):
    path = str(tmp_path / "table")
    rows = spark.createDataFrame([(k, f"t{k % 40}" if k % 7 else None, k * 1.5) for k in range(400)], "id long, ticker string, v double")
    assert snapshots.latest(spark, path) is None and snapshots.read(spark, path) is None
    assert snapshots.upsert(rows, path, "ticker", merge, ["id"], COLUMNS, buckets=16) == 0
    return path


def full(spark, path):
    return table_digest(snapshots.read(spark, path), COLUMNS).first()


def test_one_ticker_rewrites_one_bucket(spark, table):
    before = folders(spark, table)
    times = {f: f.stat().st_mtime_ns for f in Path(table).glob("data/*/bucket=*/*.parquet")}
    new = spark.createDataFrame([(3, "t3", -1.0), (4003, "t3", 7.0)], "id long, ticker string, v double")
    assert snapshots.upsert(new, table, "ticker", merge, ["id"], COLUMNS) == 1
    after = folders(spark, table)
    assert sum(before[b] != after[b] for b in before) == 1
    assert times == {f: f.stat().st_mtime_ns for f in times}
    rows = {r.id: r.v for r in snapshots.read(spark, table).collect()}
    assert len(rows) == 401 and rows[3] == -1.0 and rows[4003] == 7.0 and rows[4] == 6.0
    assert snapshots.read(spark, table, 0).count() == 400
    assert snapshots.digest(spark, table).first() == full(spark, table) != table_digest(snapshots.read(spark, table, 0), COLUMNS).first()
    assert snapshots.expire(spark, table) == 1
    assert snapshots.read(spark, table).count() == 401 and folders(spark, table) == after


def test_a_lost_job_leaves_the_table(spark, table):
    want = full(spark, table)

    def broken(old, new):
        return merge(old, new).withColumn("v", F.when(F.col("id") == 5, F.raise_error(F.lit("lost"))).otherwise(F.col("v")))

    with pytest.raises(Exception, match="lost"):
        snapshots.upsert(spark.createDataFrame([(5, "t5", 0.0)], "id long, ticker string, v double"), table, "ticker", broken, ["id"], COLUMNS)
    assert snapshots.latest(spark, table) == 0 and full(spark, table) == want == snapshots.digest(spark, table).first()
    with pytest.raises(RuntimeError):
        snapshots._commit(snapshots.snapshot(spark, table), table, 0)


def test_a_new_column_keeps_older_hashes(spark, tmp_path):
    path = str(tmp_path / "table")
    rows = spark.createDataFrame([(k, f"t{k}", k * 1.5) for k in range(50)], "id long, ticker string, v double")
    snapshots.upsert(rows, path, "ticker", merge, ["id"])
    old = {r.bucket: r.x for r in snapshots.snapshot(spark, path).collect()}
    snapshots.upsert(spark.createDataFrame([(1, "t1", 1.5, "n")], "id long, ticker string, v double, note string"), path, "ticker", merge, ["id"])
    new = {r.bucket: r.x for r in snapshots.snapshot(spark, path).collect()}
    assert sum(old[b] != new[b] for b in old) == 1
    assert {r.id: r.note for r in snapshots.read(spark, path).collect() if r.note} == {1: "n"}


def test_manifest_of_a_run(spark, tmp_path):
    rows = spark.createDataFrame([("a", "2024-01-02", "v0"), ("a", "2024-01-05", "v1"), ("b", "2024-01-03", "v0")], "symbol string, ts string, vendor string")
    run = lambda df: snapshots.write_run(df, lambda d: d.write.mode("overwrite").parquet(str(tmp_path / "out")), str(tmp_path), "r1", "bars", ["raw/v0", "raw/v1"], "ts", ["v0", "v1"])
    for df, want in ((rows, (3, "2024-01-02", "2024-01-05", 2, 1)), (rows.filter("vendor = 'v0'"), (2, "2024-01-02", "2024-01-03", 2, 0))):
        out = run(df).collect()
        assert {r.input for r in out} == {"raw/v0", "raw/v1"}
        assert {(r.records, r.start_date, r.end_date, r.records_v0, r.records_v1) for r in out} == {want}
