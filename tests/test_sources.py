"""Zip members, experiment documents, step logs; reasons of the verdict."""

import gzip
import io
import json
import zipfile

from tapewell.operators import governance as gv
from tapewell.session import files
from tapewell.sources import archives, readers


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_zip_members(spark, tmp_path):
    packed = io.BytesIO()
    with gzip.open(packed, "wb") as f:
        f.write(b"oi,ticker\n5,e\n")
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("x/one.csv", 'ticker,oi,more\na,1,z\n"b, c",,z\n')
        z.writestr("two.jsonl", '{"ticker": "d", "oi": 2}\nbroken {\n\n[1]\n{"oi": "3"}\n')
        z.writestr("three.csv.gz", packed.getvalue())
        z.writestr("empty.csv", "")
        z.writestr("notes.txt", "ticker,oi\nno,9\n")
    (tmp_path / "deep").mkdir()
    with zipfile.ZipFile(tmp_path / "deep" / "b.zip", "w") as z:
        z.writestr("one.csv", "ticker\n" + "".join(f"t{k}\n" for k in range(20_000)))
    df = archives.zip_members(spark, str(tmp_path), ["ticker", "oi"])
    assert df.rdd.getNumPartitions() == 5
    got = rows_of(df.filter("oi is not null or ticker not like 't%' or ticker is null"))
    assert got == sorted([("a", "1"), ("b, c", None), ("d", "2"), (None, "3"), ("e", "5")], key=repr)
    assert df.filter("ticker like 't%'").count() == 20_000
    assert archives.zip_members(spark, f"file:{tmp_path}/deep/b.zip", ["ticker"]).count() == 20_000
    none = tmp_path / "none"
    none.mkdir()
    assert archives.zip_members(spark, str(none), ["ticker"]).count() == 0


def test_written_archives_come_back(spark, tmp_path):
    df = spark.range(0, 25_000, 1, 3).selectExpr("cast(id as string) as ticker", "case when id % 7 > 0 then cast(id * 2 as string) end as oi")
    path = str(tmp_path / "out")
    assert archives.write_zip(df, path) == 25_000
    back = archives.zip_members(spark, path, ["ticker", "oi"])
    assert back.exceptAll(df).count() == 0 and back.count() == 25_000
    bars = readers.option_flat_files(spark, path, "zip")
    assert bars.filter("open_interest is not null").count() == sum(1 for k in range(25_000) if k % 7)


def test_experiment_documents(spark, tmp_path):
    def put(run, kind, name, text):
        folder = tmp_path / run / kind
        folder.mkdir(parents=True, exist_ok=True)
        (folder / name).write_text(text)

    put("a", "evaluation", "metrics.json", json.dumps({"performance": {"sharpe": 1.5}}, indent=1))
    put("a", "logs", "run_summary.json", '{"recorded_at": "2024-01-02"}')
    put("a", "spec", "experiment_spec.json", '{"policy": "equal"}')
    put("b", "evaluation", "metrics.json", '{"metrics": {"performance": {"sharpe": "Infinity"}}}')
    put("c", "evaluation", "metrics.json", '{"performance.sharpe": "2.5", "performance": 3}')
    put("d", "evaluation", "metrics.json", '{"performance": {')
    put("e", "spec", "experiment_spec.json", '{"policy": "sma"}')
    good, bad = readers.experiment_summaries(spark, str(tmp_path), ["performance.sharpe"], ["policy"])
    assert rows_of(good.select("experiment_id", "recorded_at", "policy", "performance_sharpe")) == [
        ("a", "2024-01-02", "equal", 1.5), ("b", None, None, None), ("c", None, None, 2.5), ("d", None, None, None)]
    assert [(r.experiment_id, r.kind) for r in bad.collect()] == [("d", "evaluation")]


def test_a_registry_of_many_experiments_takes_few_files(spark, tmp_path):
    path = str(tmp_path / "packed")
    docs = spark.range(0, 3_000, 1, 2).selectExpr(
        "explode(array(named_struct('file', concat('run-', id, '/evaluation/m.json'), 'payload', if(id % 100 = 7, '{\"performance\"', concat('{\"performance\": {\"sharpe\": ', id, '}}'))),"
        " named_struct('file', concat('run-', id, '/spec/s.json'), 'payload', '{\"policy\": \"p\"}'))) as d").select("d.*")
    readers.pack_documents(docs, path)
    assert len(list((tmp_path / "packed").glob("*.parquet"))) == 2
    good, bad = readers.experiment_summaries(spark, path, ["performance.sharpe"], ["policy"], packed=True)
    assert rows_of(good) == sorted([(f"run-{k}", None, "p", None if k % 100 == 7 else float(k)) for k in range(3_000)], key=repr)
    assert rows_of(bad.select("experiment_id", "kind", "payload")) == sorted((f"run-{k}", "evaluation", '{"performance"') for k in range(7, 3_000, 100))


def test_experiment_queries_write_few_files(spark):
    from tapewell.plans import catalog
    from tapewell.session import job

    catalog.load()
    with job(spark) as written:
        assert catalog.QUERIES["s13b_broken_documents"](spark, "/root/testdata/sf0.001").count() > 0
        for path in written:
            fs, make = files(spark, path)
            assert fs.getContentSummary(make(path)).getDirectoryCount() == 1


def test_step_log(spark, tmp_path):
    (tmp_path / "steps.jsonl").write_text('{"step": 1, "value": "2.5"}\n\n  {"step": "x", "more": [1]}\n{"step":\n17\n')
    good, bad = readers.json_lines(spark, str(tmp_path / "steps.jsonl"), "step bigint, value double")
    assert rows_of(good) == [(1, 2.5), (None, None)]
    assert rows_of(bad) == [("17",), ('{"step":',)]


def test_reasons_carry_values(spark):
    pairs = spark.createDataFrame([(k, 1) for k in range(1, 6)], "candidate long, baseline long")
    counts = spark.createDataFrame([(1, "a", 1), (1, "b", 9), (2, "a", 5), (3, "a", 0), (3, "b", 0), (5, "a", 5), (5, "b", 5)], "run_id long, mode string, steps long")
    got = rows_of(gv.mode_gates(pairs, counts, min_modes=0, min_share=0.2).select("candidate", "reason"))
    assert got == [(1, "regime_mode_fraction_below_threshold:a:0.1<0.2"), (3, "regime_mode_counts_empty"), (4, "regime_mode_counts_missing")]
    assert rows_of(gv.mode_gates(pairs, counts, min_modes=2).select("candidate", "reason")) == [
        (2, "regime_active_modes_below_threshold:1<2"), (3, "regime_active_modes_below_threshold:0<2"), (4, "regime_mode_counts_missing")]
    sweeps = spark.createDataFrame([(1, 4, 0), (2, 9, 3), (3, 9, None)], "candidate long, completed long, fails long")
    names = spark.createDataFrame([(5, "wide")], "candidate long, sweep string")
    assert rows_of(gv.sweep_gates(pairs, sweeps, min_completed=5, max_failures=2, severity="hard", names=names).select("candidate", "severity", "reason")) == [
        (1, "hard", "sweep_completed_below_threshold:4<5"), (2, "hard", "sweep_failures_exceeded:3>2"), (4, "soft", "sweep_summary_missing"), (5, "soft", "sweep_summary_missing:wide")]


def test_replay_and_execution_presence(spark):
    pairs = spark.createDataFrame([(1, 1), (2, 1), (3, 9), (4, 1)], "candidate long, baseline long")
    execution = spark.createDataFrame([(1, False), (3, True), (4, None)], "run_id long, replayed boolean")
    returns = spark.createDataFrame([(1, 0.1), (1, 0.2), (2, 0.1), (2, float("nan")), (3, None)], "run_id long, value double")
    assert rows_of(gv.presence_gates(pairs, execution, returns).select("candidate", "severity", "reason")) == sorted([
        (1, "soft", gv.SAME_RUN), (2, "hard", "deterministic_replay_missing"), (3, "soft", "execution_baseline_metrics_missing"), (4, "hard", "deterministic_replay_missing")], key=repr)
