"""Structured Streaming jobs: bars, sliding averages, sessions, upserts, quarantine, stateful monitors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from tapewell.operators.keyed import keep_best
from tapewell.session import checkpointed, scratch_path
from tapewell.sources import sinks

LATE = "10 minutes"
SLOT_MS = 3_600_000
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
END = "2200-01-01"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def read_events(spark: SparkSession, root: str, files_per_batch: int = 64) -> DataFrame:
    """The events files of a folder as a stream of trades; a batch takes a bounded number of files."""
    schema = spark.read.parquet(f"{root.rstrip('/')}/events.parquet").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events*.parquet").option("maxFilesPerTrigger", files_per_batch).parquet(root)
    return raw.select(
        F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("id"),
        F.col("value").alias("price"), "user_id", F.get_json_object("props", "$.k").cast("double").alias("k"))


def _run(writer: Callable[[], DataStreamWriter], spark: SparkSession, label: str, end: str | None) -> None:
    """Everything available; then, with ``end``, the marker of a closed feed, which moves the watermark behind all ticks.

    ``writer`` makes the same query anew for each of the two runs, which share one log.
    """
    log, before = scratch_path(spark, label + "-log"), spark.conf.get(STATE_STORE, None)
    spark.conf.set(STATE_STORE, ROCKS)  # state on disk, with timers
    try:
        for last in (False, True) if end else (False,):
            if last:
                spark.range(1).select(F.lit(END).cast("timestamp").alias("ts")).write.mode("append").parquet(end)
            writer().trigger(availableNow=True).option("checkpointLocation", log).start().awaitTermination()
    finally:
        spark.conf.set(STATE_STORE, before) if before else spark.conf.unset(STATE_STORE)


def closing(ticks: DataFrame, end: str) -> DataFrame:
    """``ticks`` with the end marker that a feed writes to the folder ``end``: a row of nulls but for its time."""
    spark = ticks.sparkSession
    spark.createDataFrame([], "ts timestamp").write.mode("append").parquet(end)
    return ticks.unionByName(spark.readStream.schema("ts timestamp").parquet(end), allowMissingColumns=True)


def drain(stream: DataFrame, label: str, mode: str = "append", end: str | None = None) -> DataFrame:
    """Run everything available through a Parquet sink and read the result back."""
    spark = stream.sparkSession
    out = scratch_path(spark, label)
    _run(lambda: stream.writeStream.format("parquet").outputMode(mode).option("path", out), spark, label, end)
    return spark.read.schema(stream.schema).parquet(out)


def drain_batches(stream: DataFrame, label: str, write: Callable[[DataFrame, int], None], end: str | None = None) -> None:
    _run(lambda: stream.writeStream.foreachBatch(write), stream.sparkSession, label, end)


def stream_bars(ticks: DataFrame, width: str = "1 hour") -> DataFrame:
    """Tumbling OHLCV bars; a bar is final once the watermark passes its end."""
    at = F.struct("ts", "id")
    g = ticks.withWatermark("ts", LATE).groupBy("symbol", F.window("ts", width).alias("w"))
    return g.agg(
        F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"),
        F.count(F.lit(1)).cast("double").alias("volume"),
    ).select("symbol", F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume")


def stream_vwap(ticks: DataFrame, width: str = "1 hour", slide: str = "15 minutes") -> DataFrame:
    """Sliding volume-weighted average price and volume per symbol."""
    qty = F.col("k") + 1.0
    g = ticks.withWatermark("ts", LATE).groupBy("symbol", F.window("ts", width, slide).alias("w"))
    out = g.agg(F.sum(F.col("price") * qty).alias("_pv"), F.sum(qty).alias("volume"))
    return out.select("symbol", F.col("w.start").alias("ts"), F.try_divide("_pv", "volume").alias("vwap"), "volume")


def stream_sessions(ticks: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Activity sessions per user, closed after ``gap`` without an event."""
    g = ticks.withWatermark("ts", LATE).groupBy("user_id", F.session_window("ts", gap).alias("w"))
    return g.agg(F.count(F.lit(1)).alias("events"), F.sum("price").alias("value")).select("user_id", F.col("w.start").alias("start"), "events", "value")


def stream_upsert(ticks: DataFrame, path: str) -> None:
    """Last price per symbol and hour in a table partitioned by day; replays change nothing.

    Repeats are dropped inside the watermark, each batch is reduced to one row per key and merged into
    the days it touches by the tick it came from, so an earlier tick never replaces a later one.
    """
    once = ticks.withWatermark("ts", LATE).dropDuplicatesWithinWatermark(["id"])

    def write(batch: DataFrame, _: int) -> None:
        new = batch.select("symbol", F.date_trunc("hour", "ts").alias("hour"), "ts", "id", "price", F.to_date("ts").alias("day"))
        new = checkpointed(keep_best(new, ["symbol", "hour"], ["ts", "id"]))
        old = sinks.read_if_exists(batch.sparkSession, path)
        rows = new if old is None else new.unionByName(old.join(new.select("day").distinct(), "day", "left_semi"))
        best = checkpointed(keep_best(rows, ["symbol", "hour"], ["ts", "id"]))
        sinks.write_sorted(best, path, ["day"], ["symbol", "hour"])

    drain_batches(once, "upsert", write)


def stream_quarantine(ticks: DataFrame, good: str, bad: str, low: float, high: float) -> None:
    """Rows outside the price range go to a quarantine table with the rule they broke."""
    rule = F.when(F.col("price").isNull(), "missing:price").when(F.col("price") < low, "low:price").when(F.col("price") > high, "high:price")
    checked = ticks.withColumn("error", rule)

    def write(batch: DataFrame, n: int) -> None:
        # one folder per batch number, so that a retried batch replaces its own output
        batch.filter("error is null").drop("error").write.mode("overwrite").parquet(f"{good}/batch={n}")
        batch.filter("error is not null").write.mode("overwrite").parquet(f"{bad}/batch={n}")

    drain_batches(checked, "quarantine", write)


class InOrder(StatefulProcessor):
    """Ticks of a key in event order, whatever batches they come in.

    A tick waits in the slot of its time until the watermark passes the slot's end; a timer then releases the slot and
    ``fold(key, state, rows) -> (output, state)`` sees its rows by (ts, id).  A slot is all that is ever sorted at once.
    When ``until(key)`` (milliseconds) has passed as well, the key's state goes.
    """

    def __init__(self, fold: Callable, state: str, slot_ms: int, until: Callable[[tuple], int] | None = None) -> None:
        self.fold, self.schema, self.slot_ms, self.until = fold, state, slot_ms, until

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "slot long", "ts array<long>, id array<long>, price array<double>")
        self.state = handle.getValueState("state", self.schema)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        if key[0] is None:
            return
        known = set(self.handle.listTimers()) if self.waiting.exists() else set()
        for frame in rows:
            frame = frame[frame["price"].notna()]
            at = frame["ts"].astype("datetime64[us]").astype("int64")
            for slot, part in frame.assign(ts=at).groupby(at // (self.slot_ms * 1000)):
                slot = (int(slot),)
                held = self.waiting.getValue(slot) if self.waiting.containsKey(slot) else ([], [], [])
                self.waiting.updateValue(slot, tuple([*old, *part[c].tolist()] for old, c in zip(held, ("ts", "id", "price"), strict=True)))
                due = (slot[0] + 1) * self.slot_ms
                if due not in known:
                    self.handle.registerTimer(due)
                    known.add(due)
        if self.until is not None and self.until(key) not in known:
            self.handle.registerTimer(self.until(key))
        yield from ()

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        due = sorted(slot for (slot,) in self.waiting.keys() if (slot + 1) * self.slot_ms <= now)
        for slot in due:
            ts, ids, price = self.waiting.getValue((slot,))
            rows = pd.DataFrame({"ts": list(ts), "id": list(ids), "price": list(price)}).sort_values(["ts", "id"], kind="mergesort")
            out, state = self.fold(key, self.state.get() if self.state.exists() else None, rows)
            self.state.update(state)
            self.waiting.removeKey((slot,))
            yield out
        if self.until is not None and now >= self.until(key):
            self.state.clear()


def _ordered(ticks: DataFrame, keys: list[str], processor: InOrder, output: str) -> DataFrame:
    """Ticks without a key, time or price are left out, by the processor: a filter here would move below the watermark and
    hide the end marker from it."""
    timed = ticks.select("symbol", "ts", "id", "price").withWatermark("ts", LATE)
    if "day" in keys:
        timed = timed.withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    return timed.groupBy(*keys).transformWithStateInPandas(processor, output, "append", "EventTime")


def stream_modes(ticks: DataFrame, high: float, low: float, min_hold: int, slot_ms: int = SLOT_MS) -> DataFrame:
    """Mode per tick (defensive above ``high``, risk_on below ``low``, else neutral), held for at
    least ``min_hold`` ticks; ticks count in event order, and are final once the watermark passes them."""

    def fold(key: tuple, state: tuple | None, rows: pd.DataFrame) -> tuple[pd.DataFrame, tuple]:
        mode, age = state or (None, 0)
        modes = []
        for price in rows["price"]:
            want = "defensive" if price >= high else "risk_on" if price <= low else "neutral"
            if mode is None or (age >= min_hold and want != mode):
                mode, age = want, 0
            age += 1
            modes.append(mode)
        return pd.DataFrame({"symbol": key[0], "id": rows["id"].to_numpy(), "mode": modes}), (mode, age)

    return _ordered(ticks, ["symbol"], InOrder(fold, "mode string, age long", slot_ms), "symbol string, id long, mode string")


def daily_values(values: DataFrame, slot_ms: int = SLOT_MS) -> DataFrame:
    """Each value with the day's first value and its peak so far that day.  A day of a portfolio is a key of its own, and
    its state goes when the watermark passes its end."""

    def fold(key: tuple, state: tuple | None, rows: pd.DataFrame) -> tuple[pd.DataFrame, tuple]:
        price = rows["price"].to_numpy()
        start, peak = state or (float(price[0]), float("-inf"))
        peaks = np.maximum.accumulate(np.maximum(price, peak))
        out = pd.DataFrame({"symbol": key[0], "day": key[1], "id": rows["id"].to_numpy(), "price": price, "start": start, "peak": peaks})
        return out, (start, float(peaks[-1]))

    def day_end(key: tuple) -> int:
        return int(pd.Timestamp(key[1], tz="UTC").timestamp() * 1000) + 86_400_000

    return _ordered(values, ["symbol", "day"], InOrder(fold, "start double, peak double", slot_ms, day_end), "symbol string, day string, id long, price double, start double, peak double")


def stream_kill_switch(values: DataFrame, path: str, max_daily_loss: float, max_drawdown: float, end: str | None = None, slot_ms: int = SLOT_MS) -> None:
    """Daily loss from the day's first value and drawdown from the running peak, per portfolio, into ``path``.

    Days are folded apart from each other; each batch then adds the peak of earlier days, which are final by then: a
    table of the last day and of all days before it, two rows per portfolio, goes from batch to batch.
    """
    folder = scratch_path(values.sparkSession, "peaks")
    schema = "symbol string, day string, peak double"

    def write(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        new = checkpointed(batch)
        old = spark.read.schema(schema).parquet(f"{folder}/{n - 1}") if n else spark.createDataFrame([], schema)
        days = old.unionByName(new.select("symbol", "day", "peak")).groupBy("symbol", "day").agg(F.max("peak").alias("peak"))
        w = Window.partitionBy("symbol").orderBy("day")
        days = checkpointed(days.withColumns({
            "before": F.max("peak").over(w.rowsBetween(Window.unboundedPreceding, -1)), "_last": F.lead("day").over(w).isNull()}))
        kept = days.groupBy("symbol", "_last").agg(F.max("day").alias("day"), F.max("peak").alias("peak"))
        kept.select("symbol", "day", "peak").write.mode("overwrite").parquet(f"{folder}/{n}")
        out = new.join(days.select("symbol", "day", "before"), ["symbol", "day"]).withColumn("peak", F.greatest("peak", "before"))

        def fall(base: str) -> Column:
            return F.when(F.col(base) > 1e-9, F.greatest(F.lit(0.0), (F.col(base) - F.col("price")) / F.col(base))).otherwise(0.0)

        out = out.withColumns({"daily_loss": fall("start"), "drawdown": fall("peak")})
        halt = F.when(F.col("daily_loss") > max_daily_loss + 1e-9, "DAILY_LOSS_LIMIT").when(F.col("drawdown") > max_drawdown + 1e-9, "TRAILING_DRAWDOWN_LIMIT")
        # one folder per batch number, so that a retried batch replaces its own output
        out.select("symbol", "id", "daily_loss", "drawdown", halt.alias("halt")).write.mode("overwrite").parquet(f"{path}/batch={n}")

    drain_batches(daily_values(values, slot_ms), "kill-switch", write, end)


def validity(known: DataFrame, keys: list[str], at: str) -> DataFrame:
    """Known-at rows with the time the next row of the key replaces them."""
    from tapewell.operators.keyed import ordinal, rolling, time_bucket

    placed = ordinal(known, keys, [at], time_bucket(at, 86_400))
    out = rolling(placed, keys, lambda f, w: {"until": F.lead(at).over(w)}, fwd=1).drop("_rn")
    return out.withColumn("until", F.coalesce("until", F.lit("9999-01-01").cast("timestamp")))


def stream_enrich(ticks: DataFrame, valid: DataFrame, at: str) -> DataFrame:
    """Each tick with the static row valid at its time; stateless, at most one match per tick.

    A row that a later one replaces is laid out over the days it holds, so ticks meet it by symbol and day; the newest row of
    a symbol, which has no end, is one row to join.
    """
    values = [c for c in valid.columns if c not in ("symbol", "until")]
    newest = F.col("until") >= F.lit("9999-01-01").cast("timestamp")
    last = valid.filter(newest).select(F.col("symbol").alias("_s"), F.struct(*values).alias("_last"))
    days = F.explode(F.sequence(F.to_date(at), F.to_date("until")))
    past = valid.filter(~newest).select(F.col("symbol").alias("_p"), days.alias("_day"), F.col("until").alias("_until"), F.struct(*values).alias("_past"))
    joined = ticks.join(last, (F.col("symbol") == F.col("_s")) & (F.col("ts") >= F.col(f"_last.{at}")), "left")
    held = (F.col("ts") >= F.col(f"_past.{at}")) & (F.col("ts") < F.col("_until"))
    joined = joined.join(past, (F.col("symbol") == F.col("_p")) & (F.to_date("ts") == F.col("_day")) & held, "left")
    found = F.coalesce("_last", "_past")
    return joined.select(*ticks.columns, *[found[c].alias(c) for c in values])
