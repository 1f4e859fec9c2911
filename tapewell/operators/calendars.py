"""Session calendars, gap filling and complete-case panels without a calendar x symbol product."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewell.operators.keyed import RN, ordinal, rolling, step_bucket, time_bucket
from tapewell.session import checkpointed


def union_calendar(bars: DataFrame, step_seconds: int, ts: str = "ts") -> DataFrame:
    """Distinct sessions with their 0-based number: ``(ts, sid)``."""
    days = bars.select(F.col(ts).alias("ts")).distinct()
    return ordinal(days, [], ["ts"], time_bucket("ts", step_seconds)).select("ts", (F.col(RN) - 1).alias("sid"))


def intersection_calendar(bars: DataFrame) -> DataFrame:
    """Sessions every symbol has."""
    pairs = bars.select("symbol", "ts").distinct()
    symbols = bars.select(F.count_distinct("symbol")).scalar()
    return pairs.groupBy("ts").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == symbols).select("ts")


def _with_gaps(bars: DataFrame, calendar: DataFrame) -> DataFrame:
    """Number the sessions of each symbol and add the number of its next session."""
    placed = ordinal(bars.join(calendar, "ts"), ["symbol"], ["sid"], step_bucket("sid"))
    return rolling(placed, ["symbol"], lambda f, w: {"next_sid": F.lead("sid").over(w)}, fwd=1)


def forward_filled(bars: DataFrame, calendar: DataFrame, limit: int = 3) -> DataFrame:
    """Bars carried over missing sessions for at most ``limit`` sessions.

    Only rows that hold a value are made; sessions further from the last bar stay absent (null in a
    dense grid).  Adds ``filled``.
    """
    spread = _with_gaps(bars, calendar).withColumnRenamed("ts", "bar_ts").drop(RN)
    stop = F.least(F.col("sid") + limit, F.coalesce(F.col("next_sid") - 1, F.col("sid") + limit))
    spread = spread.withColumn("at", F.explode(F.sequence("sid", stop)))
    return (
        spread.join(calendar.select(F.col("sid").alias("at"), "ts"), "at")
        .withColumn("filled", F.col("at") != F.col("sid"))
        .drop("sid", "next_sid", "bar_ts").withColumnRenamed("at", "sid")
    )


def _fill_inside(filled: DataFrame, columns: Sequence[str], limit: int) -> DataFrame:
    """Fill single nulls of ``columns`` from real rows at most ``limit`` sessions back."""
    placed = ordinal(filled, ["symbol"], ["sid"], step_bucket("sid"))

    def seen(f, w):
        cells = {}
        for c in columns:
            known = F.when(~F.col("filled") & F.col(c).isNotNull(), F.struct(F.col("sid").alias("at"), F.col(c).alias("v")))
            last = F.last(known, ignorenulls=True).over(f(-limit, 0))
            cells[c] = F.when(F.col("sid") - last["at"] <= limit, last["v"])
        return cells

    return rolling(placed, ["symbol"], seen, back=limit).drop(RN)


def complete_panel(
    bars: DataFrame, step_seconds: int, limit: int = 3, calendar: DataFrame | None = None, gappy: Sequence[str] = (),
) -> DataFrame:
    """Keep the sessions on which every symbol has a bar after filling; ``_rn`` numbers them.

    ``gappy`` names columns that may be null on a real bar; those nulls are filled too.
    """
    calendar = calendar if calendar is not None else union_calendar(bars, step_seconds)
    filled = checkpointed(forward_filled(bars, calendar, limit))
    if gappy:
        filled = checkpointed(_fill_inside(filled, gappy, limit))
    symbols = bars.select(F.count_distinct("symbol")).scalar()
    whole = (
        filled.groupBy("ts", "sid").agg(F.count("close").alias("n"))
        .filter(F.col("n") == symbols).select("ts", "sid")
    )
    numbered = ordinal(whole, [], ["sid"], step_bucket("sid")).select("ts", RN)
    return checkpointed(filled.drop("sid").join(numbered, "ts"))


def dense_grid(bars: DataFrame, calendar: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Every session from a symbol's first to the calendar's last; ``columns`` null where no bar."""
    last = calendar.select(F.max("sid")).scalar()
    spread = _with_gaps(bars, calendar).drop(RN, "ts")
    stop = F.coalesce(F.col("next_sid") - 1, last)
    spread = spread.withColumn("at", F.explode(F.sequence("sid", stop)))
    real = F.col("at") == F.col("sid")
    return spread.select(
        "symbol", F.col("at").alias("sid"), *[F.when(real, F.col(c)).alias(c) for c in columns],
    ).join(calendar, "sid")


def missing_ranges(bars: DataFrame, calendar: DataFrame) -> DataFrame:
    """Runs of absent calendar sessions per symbol: ``(symbol, start, end, days)``.

    Found from the jump in session number between neighbouring bars; the stretches before the first
    and after the last bar are added, and no grid is built.
    """
    first, last = calendar.select(F.min("sid")).scalar(), calendar.select(F.max("sid")).scalar()
    gaps = _with_gaps(bars, calendar).withColumn("lo", F.col("sid") + 1)
    inner = gaps.select("symbol", "lo", (F.coalesce(F.col("next_sid"), last + 1) - 1).alias("hi"))
    head = bars.join(calendar, "ts").groupBy("symbol").agg((F.min("sid") - 1).alias("hi")).select("symbol", first.alias("lo"), "hi")
    runs = inner.unionByName(head).filter(F.col("lo") <= F.col("hi"))
    start = calendar.select(F.col("sid").alias("lo"), F.col("ts").alias("start"))
    end = calendar.select(F.col("sid").alias("hi"), F.col("ts").alias("end"))
    return runs.join(start, "lo").join(end, "hi").select(
        "symbol", "start", "end", (F.col("hi") - F.col("lo") + 1).alias("days"),
    )


def fill_limits(df: DataFrame, keys: Sequence[str], columns: Sequence[str], *, forward: int, backward: int = 0) -> DataFrame:
    """Fill nulls from at most ``forward`` rows back, then at most ``backward`` rows ahead (``_rn`` given)."""

    def ahead(f, w):
        return {c: F.coalesce(F.col(c), F.last(c, ignorenulls=True).over(f(-forward, 0))) for c in columns}

    def behind(f, w):
        return {c: F.coalesce(F.col(c), F.first(c, ignorenulls=True).over(f(0, backward))) for c in columns}

    stages = [ahead] + ([behind] if backward else [])
    return rolling(df, keys, *stages, back=forward, fwd=backward)
