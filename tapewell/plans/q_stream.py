"""Queries: streaming jobs run to the end of the available data."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapewell.plans.catalog import cte, query
from tapewell.session import scratch_path
from tapewell.streaming import jobs

DAY_MS = 86_400_000  # ticks are hours apart here, so a day is a slot
FINAL = "(SELECT max(ts) - INTERVAL 10 MINUTE FROM events)"


def ticks(t):
    return jobs.read_events(t.spark, t.root)


@query("r01_stream_bars", "symbol ts:t open:f high:f low:f close:f volume:f", f"SELECT * FROM bars_h WHERE ts + INTERVAL 1 HOUR <= {FINAL}")
def _(t):
    """Bars that are final: their end lies before the watermark."""
    return jobs.drain(jobs.stream_bars(ticks(t)), "bars")


@query("r02_stream_vwap", "symbol ts:t vwap:f8 volume:f", f"""
SELECT symbol, w AS ts, sum(p * q) / sum(q) AS vwap, sum(q) AS volume FROM (
  SELECT event_type AS symbol, time_bucket(INTERVAL 15 MINUTE, ts) - k * INTERVAL 15 MINUTE AS w, value AS p, CAST(json_extract_string(props, '$.k') AS DOUBLE) + 1 AS q FROM events, (SELECT unnest(range(0, 4)) AS k))
GROUP BY 1, 2 HAVING w + INTERVAL 1 HOUR <= {FINAL}
""")
def _(t):
    return jobs.drain(jobs.stream_vwap(ticks(t)), "vwap")


@query("r03_stream_sessions", "user_id:i start:t events:i value:f4", f"""
SELECT user_id, min(ts) AS start, count(*) AS events, sum(value) AS value FROM (
  SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (
    SELECT *, CAST(coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) > INTERVAL 30 MINUTE, true) AS INT) AS n FROM events))
GROUP BY user_id, s HAVING max(ts) + INTERVAL 30 MINUTE <= {FINAL}
""")
def _(t):
    return jobs.drain(jobs.stream_sessions(ticks(t)), "sessions")


@query("r04_stream_upsert", "symbol hour:t price:f", "SELECT symbol, ts AS hour, close AS price FROM bars_h")
def _(t):
    """Every trade arrives twice; the table holds the last one per hour."""
    path = scratch_path(t.spark, "last-price")
    jobs.stream_upsert(ticks(t).union(ticks(t)), path)
    return t.spark.read.parquet(path)


@query("r05_stream_quarantine", "id:i error", "SELECT event_id AS id, CASE WHEN value < 1 THEN 'low:price' WHEN value > 40 THEN 'high:price' END AS error FROM events")
def _(t):
    good, bad = scratch_path(t.spark, "good"), scratch_path(t.spark, "bad")
    jobs.stream_quarantine(ticks(t), good, bad, 1.0, 40.0)
    ok = t.spark.read.parquet(good).select("id", F.lit(None).cast("string").alias("error"))
    return ok.unionByName(t.spark.read.parquet(bad).select("id", "error"))


@query("r06_stream_modes", "symbol id:i mode", """
WITH RECURSIVE o AS (SELECT event_type AS symbol, event_id AS id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS i, CASE WHEN value >= 20 THEN 'defensive' WHEN value <= 3 THEN 'risk_on' ELSE 'neutral' END AS want FROM events),
r AS (SELECT symbol, id, i, want AS mode, CAST(1 AS BIGINT) AS age FROM o WHERE i = 1
  UNION ALL SELECT o.symbol, o.id, o.i, CASE WHEN age >= 5 THEN want ELSE mode END, CASE WHEN age >= 5 AND want <> mode THEN 1 ELSE age + 1 END FROM r JOIN o ON o.symbol = r.symbol AND o.i = r.i + 1)
SELECT symbol, id, mode FROM r
""")
def _(t):
    """The feed is closed behind its last tick, so every tick becomes final."""
    end = scratch_path(t.spark, "end")
    return jobs.drain(jobs.stream_modes(jobs.closing(ticks(t), end), 20.0, 3.0, 5, DAY_MS), "modes", end=end)


@query("r07_stream_kill_switch", "symbol id:i daily_loss:f drawdown:f halt", """
SELECT symbol, id, dl AS daily_loss, dd AS drawdown, CASE WHEN dl > 0.9 + 1e-9 THEN 'DAILY_LOSS_LIMIT' WHEN dd > 0.95 + 1e-9 THEN 'TRAILING_DRAWDOWN_LIMIT' END AS halt FROM (
  SELECT symbol, id, greatest(0, (s - v) / s) AS dl, greatest(0, (p - v) / p) AS dd FROM (
    SELECT event_type AS symbol, event_id AS id, value AS v, first_value(value) OVER (PARTITION BY event_type, CAST(ts AS DATE) ORDER BY ts, event_id) AS s, max(value) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS p FROM events))
""")
def _(t):
    end, path = scratch_path(t.spark, "end"), scratch_path(t.spark, "halts")
    jobs.stream_kill_switch(jobs.closing(ticks(t), end), path, 0.9, 0.95, end, DAY_MS)
    return t.spark.read.parquet(path)


cte("daily_mean", "SELECT symbol, date_trunc('day', ts) + INTERVAL 1 DAY AS known_at, avg(close) AS mean_close FROM bars_h GROUP BY 1, 2")


@query("r08_stream_asof", "symbol id:i known_at:t mean_close:f", """
SELECT e.event_type AS symbol, e.event_id AS id, d.known_at, d.mean_close FROM events e ASOF LEFT JOIN daily_mean d ON e.event_type = d.symbol AND e.ts >= d.known_at
""")
def _(t):
    """Ticks with the latest daily mean known at their time."""
    day = F.date_trunc("day", "ts") + F.expr("INTERVAL 1 DAY")
    known = t.bars_h().groupBy("symbol", day.alias("known_at")).agg(F.avg("close").alias("mean_close"))
    return jobs.drain(jobs.stream_enrich(ticks(t), jobs.validity(known, ["symbol"], "known_at"), "known_at"), "asof")
