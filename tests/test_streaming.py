"""Stateful jobs give the same rows for any number of batches, with ticks that come late."""

import random
from datetime import datetime, timedelta, timezone

import pytest

from tapewell.streaming import jobs

HIGH, LOW, HOLD, LOSS, FALL, SLOT = 20.0, 3.0, 4, 0.5, 0.8, 4 * 3_600_000


def feed():
    rng = random.Random(6)
    at = datetime(2024, 3, 1, 20, tzinfo=timezone.utc)
    ticks = []
    for k in range(900):
        at += timedelta(seconds=rng.randint(1, 500))
        ticks.append(("hot" if k % 3 else f"s{k % 5}", at, k, round(rng.uniform(1, 30), 2)))
    # a tick arrives up to nine minutes after its time
    return sorted(ticks, key=lambda t: (t[1] + timedelta(seconds=random.Random(t[2]).randint(0, 540)), t[2]))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    ticks, root = feed(), tmp_path_factory.mktemp("feed")
    for k in range(10):
        part = ticks[k * 90 : (k + 1) * 90]
        rows = [(i, s, t, p, 1, '{"k": 1}') for s, t, i, p in part]
        spark.createDataFrame(rows, "event_id long, event_type string, ts timestamp, value double, user_id long, props string").coalesce(1).write.parquet(str(root / f"part-{k}"))
        next((root / f"part-{k}").glob("*.parquet")).rename(root / f"events-{k}.parquet")
    (root / "events.parquet").symlink_to(root / "events-0.parquet")
    return root


def stream(spark, folder, files, end):
    schema = "event_id long, event_type string, ts timestamp, value double"
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events-*.parquet").option("maxFilesPerTrigger", files).parquet(str(folder))
    return jobs.closing(raw.selectExpr("event_type as symbol", "ts", "event_id as id", "value as price"), end)


def by_symbol():
    out = {}
    for s, t, i, p in sorted(feed(), key=lambda t: (t[1], t[2])):
        out.setdefault(s, []).append((t, i, p))
    return out


@pytest.mark.parametrize("files", [10, 4, 1])
def test_modes(spark, folder, tmp_path, files):
    want = []
    for s, rows in by_symbol().items():
        mode, age = None, 0
        for _, i, p in rows:
            w = "defensive" if p >= HIGH else "risk_on" if p <= LOW else "neutral"
            if mode is None or (age >= HOLD and w != mode):
                mode, age = w, 0
            age += 1
            want.append((s, i, mode))
    end = str(tmp_path / "end")
    got = jobs.drain(jobs.stream_modes(stream(spark, folder, files, end), HIGH, LOW, HOLD, SLOT), "modes", end=end)
    assert sorted(map(tuple, got.collect())) == sorted(want)


@pytest.mark.parametrize("files", [10, 4, 1])
def test_kill_switch(spark, folder, tmp_path, files):
    want = []
    for s, rows in by_symbol().items():
        day, start, peak = None, 0.0, 0.0
        for t, i, p in rows:
            if t.date() != day:
                day, start = t.date(), p
            peak = max(peak, p)
            loss, fall = max(0.0, (start - p) / start), (peak - p) / peak
            halt = "DAILY_LOSS_LIMIT" if loss > LOSS + 1e-9 else "TRAILING_DRAWDOWN_LIMIT" if fall > FALL + 1e-9 else None
            want.append((s, i, loss, fall, halt))
    end, out = str(tmp_path / "end"), str(tmp_path / "halts")
    jobs.stream_kill_switch(stream(spark, folder, files, end), out, LOSS, FALL, end, SLOT)
    got = [tuple(r) for r in spark.read.parquet(out).select("symbol", "id", "daily_loss", "drawdown", "halt").collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert {w[4] for w in want} == {None, "DAILY_LOSS_LIMIT", "TRAILING_DRAWDOWN_LIMIT"}
