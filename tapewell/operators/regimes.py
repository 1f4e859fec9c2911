"""Regime labels, contiguous regime windows and regime thresholds."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapewell.operators.keyed import RN, quantiles, quantiles_beside, rolling, running
from tapewell.session import checkpointed

LOW, MID, HIGH = "low_vol", "mid_vol", "high_vol"
V2_BUCKETS = ("high_vol_trend_up", "high_vol_trend_down", "high_vol_flat", "low_vol_trend_up", "low_vol_trend_down", "low_vol_flat")


def _attach(df: DataFrame, small: DataFrame) -> DataFrame:
    """The single row of ``small`` beside each row, a scalar subquery per column."""
    small = checkpointed(small)
    return df.withColumns({c: small.select(c).scalar() for c in small.columns})


def label_v1(df: DataFrame, keys: Sequence[str], vol: str) -> DataFrame:
    """Low, mid or high volatility by the 0.33 and 0.66 quantiles of the run's own series (a row per step); without keys of
    the whole, which may be of any size."""
    probs = {"q33": 0.33, "q66": 0.66}
    out = quantiles_beside(df, keys, vol, probs) if keys else _attach(df, quantiles(df, keys, vol, probs))
    v = F.col(vol)
    return out.withColumn("label", F.when(v <= F.col("q33"), LOW).when(v <= F.col("q66"), MID).otherwise(HIGH))


def label_v2(vol: Column, trend: Column, vol_high: Column | float, deadzone: float) -> Column:
    """High or low volatility crossed with trend up, down or flat."""
    side = F.when(trend >= deadzone, "trend_up").when(trend <= -deadzone, "trend_down").otherwise("flat")
    return F.concat(F.when(vol >= vol_high, "high_vol_").otherwise("low_vol_"), side)


def contiguous_windows(df: DataFrame, keys: Sequence[str], label: str, wanted: Sequence[str], min_rows: int) -> DataFrame:
    """Maximal runs of rows whose label is in ``wanted``, at least ``min_rows`` long."""
    keys = list(keys)

    def starts(f, w):
        hit = F.coalesce(F.col(label).isin(list(wanted)), F.lit(False))
        before = F.coalesce(F.lag(hit).over(w), F.lit(False))
        return {"_hit": hit, "_new": (hit & ~before).cast("int")}

    marked = checkpointed(rolling(df, keys, starts, back=1))
    runs = running(marked, keys, {"_run": ("sum", "_new")}).filter("_hit")
    out = runs.groupBy(*keys, "_run").agg(F.min("ts").alias("start"), F.max("ts").alias("end"), F.count(F.lit(1)).alias("days"))
    return out.filter(F.col("days") >= min_rows).drop("_run")
