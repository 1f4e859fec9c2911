"""Strategy returns, equity curves and summary metrics over many symbols or runs at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapewell.operators.keyed import RN, drawdown, rolling

YEAR = 252


def geometric_annual(total: Column, periods: Column) -> Column:
    return F.pow(1.0 + total, F.lit(float(YEAR)) / F.greatest(periods, F.lit(1))) - 1.0


def strategy_curve(positions: DataFrame, share: float = 1.0) -> DataFrame:
    """Position times return on a ``share`` of capital, compounded, with the drawdown from a peak of
    at least 1."""
    growth = positions.withColumn("strategy_ret", F.col("position") * F.col("ret") * share)
    return drawdown(growth.withColumn("_g", 1.0 + F.col("strategy_ret")), ["symbol"], "_g", seed=1.0).drop("_g")


def backtest_summary(curve: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Total and annualised return, volatility, geometric Sharpe, drawdown and trade count per key."""
    keys = list(keys)
    traded = rolling(curve, keys, lambda f, w: {"_flip": (F.col("position") != F.lag("position").over(w)).cast("int")}, back=1)
    m = traded.groupBy(*keys).agg(
        (F.max_by("equity", RN) - 1.0).alias("total_return"),
        F.count(F.when(F.col(RN) > 1, 1)).alias("periods"),
        (F.coalesce(F.stddev_pop(F.when(F.col(RN) > 1, F.col("strategy_ret"))), F.lit(0.0)) * YEAR**0.5).alias("annualized_volatility"),
        F.abs(F.least(F.min("drawdown"), F.lit(0.0))).alias("max_drawdown"),
        F.coalesce(F.sum("_flip"), F.lit(0)).alias("number_of_trades"),
    )
    m = m.withColumn("annualized_return", geometric_annual(F.col("total_return"), F.col("periods")))
    return m.withColumn("sharpe_geo", F.coalesce(F.try_divide("annualized_return", "annualized_volatility"), F.lit(0.0)))


def equal_weight(curve: DataFrame) -> DataFrame:
    """Mean strategy return per session over all symbols, and its equity curve.

    ``misaligned`` counts symbols missing on the session; it must be 0 everywhere.
    """
    symbols = curve.select(F.count_distinct("symbol")).scalar()
    mean = curve.groupBy("ts", RN).agg(F.avg("strategy_ret").alias("ret"), (symbols - F.count(F.lit(1))).alias("misaligned"))
    return drawdown(mean.withColumn("_g", 1.0 + F.col("ret")), [], "_g", seed=1.0).drop("_g")
