"""Insider-trade features on the equity sessions of a symbol."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewell.operators.keyed import RN, rolling
from tapewell.session import checkpointed

# Roles, security and windows.
ROLES = "CEO|CFO|COO|CTO|PRESIDENT|CHAIRMAN"
HIGH_ROLES = "CEO|CFO|CHAIRMAN"
SECURITY = "Common Stock"
MIN_SHARE = 0.001
SPAN_ROWS = 512
RATIO_ROWS, CLUSTER_ROWS, OWNERSHIP_ROWS, BLOCK_ROWS, HISTORY_ROWS = 30, 10, 30, 30, 756


def dollar_volume(bars: DataFrame) -> DataFrame:
    """Numbered bars with ``adv``, the 20-row mean of close x volume (20 rows needed)."""

    def adv(f, w):
        dv = F.col("close") * F.col("volume")
        return {"adv": F.when(F.count(dv).over(f(-19, 0)) == 20, F.avg(dv).over(f(-19, 0)))}

    return rolling(bars, ["symbol"], adv, back=19)


def relevant(trades: DataFrame, bars_adv: DataFrame) -> DataFrame:
    """Trades of senior insiders in common stock on a session with known dollar volume, large enough,
    with the session's ``_rn``, ``adv`` and role weight."""
    s = bars_adv.select("symbol", F.col("day").alias("filing_date"), RN, "adv").filter(F.col("adv") > 0)
    title = F.upper(F.coalesce("title", F.lit("")))
    director = F.coalesce("is_board_director", F.lit(False))
    out = trades.join(s, ["symbol", "filing_date"]).filter(
        (title.rlike(ROLES) | director) & (F.col("security_title") == SECURITY)
        & F.col("value").isNotNull() & F.col("shares").isNotNull() & (F.col("value") >= F.col("adv") * MIN_SHARE)
    )
    return out.withColumn("role_weight", F.when(title.rlike(HIGH_ROLES), 3.0).when(director, 2.0).otherwise(1.0))


def session_flows(chosen: DataFrame) -> DataFrame:
    """Bought and sold value and the role-weighted buying score per session."""
    buy, sell = F.col("shares") > 0, F.col("shares") < 0
    return chosen.groupBy("symbol", RN).agg(
        F.coalesce(F.sum(F.when(buy, F.col("value"))), F.lit(0.0)).alias("buy"),
        F.coalesce(F.sum(F.when(sell, F.col("value"))), F.lit(0.0)).alias("sell"),
        F.coalesce(F.sum(F.when(buy, F.col("role_weight") * (F.col("value") / F.col("adv")))), F.lit(0.0)).alias("score"),
    )


def _sweep(pdf: pd.DataFrame, first: int, last: int, rows: int) -> tuple[list[int], list[float]]:
    """Sessions from ``first`` to ``last`` on which an insider is seen, and their median change, by enter and leave events.

    Each insider's trades in the window are a queue; a change of its ends replaces the insider's value in one ordered list.
    """
    trades = list(zip(pdf[RN].tolist(), pdf["id"].tolist(), pdf["name"].tolist(), pdf["before"].tolist(), pdf["after"].tolist()))
    trades.sort(key=lambda t: t[:2])
    events = sorted([(t[0], 1, k) for k, t in enumerate(trades)] + [(t[0] + rows, 0, k) for k, t in enumerate(trades)])
    queues: dict[str, deque] = {}
    value: dict[str, float] = {}
    values: list[float] = []
    out, medians = [], []
    at = 0
    while at < len(events):
        session = events[at][0]
        touched = set()
        while at < len(events) and events[at][0] == session:
            _, enters, k = events[at]
            name = trades[k][2]
            queue = queues.setdefault(name, deque())
            queue.append(trades[k]) if enters else queue.popleft()
            touched.add(name)
            at += 1
        for name in touched:
            if name in value:
                del values[bisect_left(values, value.pop(name))]
            queue = queues[name]
            if not queue:
                del queues[name]
                continue
            before = queue[0][3]
            after = queue[-1]
            for t in reversed(queue):  # of the newest session, the trade of smallest id
                if t[0] != after[0]:
                    break
                after = t
            if before > 0:
                value[name] = (after[4] - before) / before
                insort(values, value[name])
        until = events[at][0] if at < len(events) else session
        if values:
            n = len(values)
            lo, hi = values[(n - 1) // 2], values[n // 2]
            for s in range(max(session, first), min(until, last + 1)):
                out.append(s)
                medians.append(lo + (hi - lo) * 0.5)
    return out, medians


def ownership_delta(chosen: DataFrame, sessions: DataFrame, rows: int = OWNERSHIP_ROWS, span: int = SPAN_ROWS) -> DataFrame:
    """Median over insiders of the relative holding change within the last ``rows`` sessions.

    Per insider, first ``before`` and last ``after`` change only when a trade enters the window or leaves it.  Trades go to
    their own span of ``span`` sessions, and to the next one if they are still visible there; each span is swept once.
    """
    name = F.trim(F.coalesce("name", F.lit("")))
    moves = chosen.filter((name != "") & F.col("before").isNotNull() & F.col("after").isNotNull())
    own, next_ = F.floor(F.col(RN) / span), F.floor((F.col(RN) + (rows - 1)) / span)
    seen = moves.select("symbol", name.alias("name"), F.col(RN).cast("long").alias(RN), F.col("id").cast("long").alias("id"), F.col("before").cast("double").alias("before"),
                        F.col("after").cast("double").alias("after"), F.explode(F.sequence(own, next_)).alias("_span"))

    def sweep(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        at, medians = _sweep(pdf, int(key[1]) * span, int(key[1]) * span + span - 1, rows)
        return pd.DataFrame({"symbol": key[0], RN: np.array(at, np.int64), "delta": np.array(medians, np.float64)})

    delta = seen.groupBy("symbol", "_span").applyInPandas(sweep, f"symbol string, {RN} long, delta double")
    return sessions.select("symbol", RN).join(delta, ["symbol", RN], "left").fillna(0.0, ["delta"])


def insiders_v1(bars: DataFrame, trades: DataFrame) -> DataFrame:
    """Buy/sell ratio, cluster score, buying-intensity percentile and ownership change per session.

    ``bars`` has symbol, day, close, volume and ``_rn``.
    """
    adv = checkpointed(dollar_volume(bars))
    chosen = checkpointed(relevant(trades, adv))
    grid = adv.join(session_flows(chosen), ["symbol", RN], "left").fillna(0.0, ["buy", "sell", "score"])

    def sums(f, w):
        return {
            "_b30": F.sum("buy").over(f(-(RATIO_ROWS - 1), 0)), "_s30": F.sum("sell").over(f(-(RATIO_ROWS - 1), 0)),
            "insider_cluster_score_10d": F.sum("score").over(f(-(CLUSTER_ROWS - 1), 0)),
        }

    def intensity(f, w):
        blocks = HISTORY_ROWS // BLOCK_ROWS
        past = [F.lag("_b30", HISTORY_ROWS - BLOCK_ROWS * k).over(w) for k in range(blocks)]
        share = sum((F.when(p <= F.col("_b30"), 1.0).otherwise(0.0) for p in past[1:]), F.when(past[0] <= F.col("_b30"), 1.0).otherwise(0.0)) / blocks
        silent = F.col("_b30") == 0.0
        for p in past:
            silent = silent & (p == 0.0)
        return {"insider_intensity_pctl_30d": F.when(F.col(RN) >= HISTORY_ROWS + BLOCK_ROWS, F.when(silent, 0.5).otherwise(share))}

    out = rolling(grid, ["symbol"], sums, intensity, back=HISTORY_ROWS + BLOCK_ROWS)
    out = out.withColumn("insider_filtered_bsr_30d", (F.col("_b30") - F.col("_s30")) / (F.col("_b30") + F.col("_s30") + 1.0))
    own = ownership_delta(chosen, adv).withColumnRenamed("delta", "insider_ownership_delta_30d")
    return out.join(own, ["symbol", RN]).drop("_b30", "_s30", "buy", "sell", "score", "adv")


INSIDER_COLUMNS = ("insider_filtered_bsr_30d", "insider_cluster_score_10d", "insider_intensity_pctl_30d", "insider_ownership_delta_30d")
