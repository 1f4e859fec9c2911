"""Stress mutations, gates and windows, regime thresholds, session splits and daily run summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapewell.operators import metrics as mt
from tapewell.operators.keyed import quantiles
from tapewell.operators.regimes import V2_BUCKETS, contiguous_windows, label_v2


def _inside(ts: str, start: str, end: str) -> Column:
    return F.col(ts).cast("date").between(F.lit(start).cast("date"), F.lit(end).cast("date"))


def shock(column: str, ts: str, start: str, end: str, magnitude: float) -> Column:
    """x * (1 + m) inside the window."""
    return F.when(_inside(ts, start, end), F.col(column) * (1.0 + magnitude)).otherwise(F.col(column))


def drift(column: str, ts: str, start: str, end: str, magnitude: float) -> Column:
    """x * (1 + m) ** days since the window began."""
    days = F.datediff(F.col(ts).cast("date"), F.lit(start).cast("date"))
    return F.when(_inside(ts, start, end), F.col(column) * F.pow(F.lit(1.0 + magnitude), days)).otherwise(F.col(column))


def spike(column: str, ts: str, start: str, end: str, factor: float) -> Column:
    """A volatility column multiplied inside the window."""
    return F.when(_inside(ts, start, end), F.col(column) * factor).otherwise(F.col(column))


def stress_gates(
    steps: DataFrame, fills: DataFrame, *, max_drawdown: float = 1.0, warn_drawdown: float | None = None,
    var_95: float = 1.0, var_99: float = 1.0, min_volume: float = 0.0,
) -> DataFrame:
    """Drawdown, value-at-risk and liquidity verdict per run; a run without fills passes liquidity."""
    warn = max_drawdown if warn_drawdown is None else warn_drawdown
    dd = steps.groupBy("run_id").agg(F.abs(F.min("drawdown")).alias("measured"))
    dd = dd.select("run_id", F.lit("drawdown").alias("gate"),
                   F.when(F.col("measured") >= max_drawdown, "fail").when(F.col("measured") >= warn, "warn").otherwise("pass").alias("status"), "measured")
    var = mt.historical_var(steps, {"v95": 0.95, "v99": 0.99})
    var = var.select("run_id", F.lit("var_limit").alias("gate"),
                     F.when((F.col("v95") > var_95) | (F.col("v99") > var_99), "fail").otherwise("pass").alias("status"), F.col("v95").alias("measured"))
    vol = fills.groupBy("run_id").agg(F.avg(F.abs("notional")).alias("measured"))
    vol = steps.select("run_id").distinct().join(vol, "run_id", "left").select(
        "run_id", F.lit("liquidity").alias("gate"),
        F.when(F.col("measured") < min_volume, "fail").otherwise("pass").alias("status"), F.coalesce("measured", F.lit(0.0)).alias("measured"))
    return dd.unionByName(var).unionByName(vol)


def stress_rollup(gates: DataFrame, scenario: str = "scenario") -> DataFrame:
    """Run status is its worst gate; counts per scenario, which fails with any failed or errored run."""
    rank = F.when(F.col("status").isin("fail", "error"), 2).when(F.col("status") == "warn", 1).otherwise(0)
    runs = gates.groupBy(scenario, "run_id").agg(F.max(rank).alias("_w"))
    return runs.groupBy(scenario).agg(
        F.count(F.lit(1)).alias("runs"), F.count_if(F.col("_w") == 0).alias("passes"), F.count_if(F.col("_w") == 1).alias("warns"),
        F.count_if(F.col("_w") == 2).alias("fails"), F.when(F.max("_w") == 2, "fail").otherwise("pass").alias("overall"),
    )


# The labels that each filter name covers.
ALIASES = {
    "crash": ("high_vol", "high_vol_trend_down"),
    "high_vol": ("high_vol", "high_vol_trend_up", "high_vol_trend_down", "high_vol_flat"),
    "low_vol": ("low_vol", "low_vol_trend_up", "low_vol_trend_down", "low_vol_flat"),
    "mid_vol": ("mid_vol",),
    "trending": ("low_vol_trend_up", "high_vol_trend_up"),
    "trend_up": ("low_vol_trend_up", "high_vol_trend_up"),
    "trend_down": ("low_vol_trend_down", "high_vol_trend_down"),
}


def find_windows(labelled: DataFrame, wanted: str, min_rows: int, keys: Sequence[str] = ()) -> DataFrame:
    """Contiguous windows of the labels a filter name covers; other names are labels themselves."""
    name = wanted.lower().strip()
    return contiguous_windows(labelled, list(keys), "label", ALIASES.get(name, (name,)), min_rows)


def bucket_distribution(days: DataFrame, vol: str, trend: str, vol_high: float, deadzone: float, min_share: float) -> DataFrame:
    """Share of days in each of the six v2 buckets, with a minimum-share flag and the sum of shares."""
    names = days.sparkSession.createDataFrame([(b,) for b in V2_BUCKETS], "label string")
    counts = days.groupBy(label_v2(F.col(vol), F.col(trend), vol_high, deadzone).alias("label")).agg(F.count(F.lit(1)).alias("days"))
    total = days.select(F.count(F.lit(1))).scalar()
    out = F.broadcast(names).join(counts, "label", "left").fillna(0, ["days"])
    out = out.withColumn("share", F.try_divide(F.col("days").cast("double"), total))
    return out.withColumn("enough", F.col("share") >= min_share).withColumn("total_share", F.try_divide(counts.select(F.sum("days")).scalar().cast("double"), total))


def fit_threshold(days: DataFrame, vol: str, p: float = 0.90) -> DataFrame:
    return quantiles(days, [], vol, {"vol_high": p})


# Numbers of months.
MONTH_CHOICES = (1, 3, 4, 6, 12)


def _monthly(days: DataFrame) -> DataFrame:
    """Sessions per calendar month with the month's distance from the last one."""
    d = days.select("day").distinct()
    per = d.groupBy(F.trunc("day", "month").alias("month")).agg(F.count(F.lit(1)).alias("n"))
    last = per.select(F.max("month")).scalar()
    return per.withColumn("age", F.round(F.months_between(last, "month")).cast("int"))


def recent_month_sessions(days: DataFrame) -> DataFrame:
    """Sessions in the last 1, 3, 4, 6 and 12 calendar months."""
    m = _monthly(days)
    sums = m.agg(*[F.coalesce(F.sum(F.when(F.col("age") < k, F.col("n"))), F.lit(0)).alias(str(k)) for k in MONTH_CHOICES])
    return sums.unpivot([], [str(k) for k in MONTH_CHOICES], "months", "sessions").withColumn("months", F.col("months").cast("int"))


def train_test_split(days: DataFrame, test_share: float = 0.2, months: int | None = None) -> DataFrame:
    """Train and test ranges: the test part is the number of whole calendar months nearest to its share;
    data of a single month is halved."""
    m = _monthly(days)
    cells = [F.sum(F.when(F.col("age") < k, F.col("n"))).alias(f"_m{k}") for k in MONTH_CHOICES]
    fact = m.agg(F.sum("n").alias("_n"), F.count(F.lit(1)).alias("_months"), *cells)
    choices = [F.struct(F.abs(F.col(f"_m{k}") - F.col("_n") * test_share).alias("gap"), F.lit(k).alias("months"), F.col(f"_m{k}").alias("test"))
               for k in MONTH_CHOICES if months is None or k == months]
    pick = F.array_min(F.array(*choices))
    half = F.floor(F.col("_n") / 2)
    fact = fact.withColumn("_p", pick)
    test = F.when(F.col("_months") <= 1, F.greatest(half, F.lit(1), F.least(F.lit(10), F.greatest(F.col("_n") - 1, F.lit(1)))))
    test = test.when(F.col("_p.test") >= F.col("_n"), F.greatest(F.col("_m1"), half, F.lit(1))).otherwise(F.col("_p.test"))
    fact = fact.withColumn("_t0", test)
    fact = fact.withColumn("_t", F.when(F.col("_t0") >= F.col("_n"), F.col("_n") - 1).otherwise(F.col("_t0")))
    fact = fact.select("_n", (F.col("_n") - F.greatest(F.col("_n") - F.col("_t"), F.lit(1))).alias("test_sessions"), F.when(F.col("_months") > 1, F.col("_p.months")).alias("months"))
    from tapewell.operators.keyed import RN, ordinal, time_bucket

    numbered = ordinal(days.select("day").distinct(), [], ["day"], time_bucket("day", 86_400))
    cut = fact.select(F.col("_n") - F.col("test_sessions")).scalar()
    out = numbered.agg(
        F.min("day").alias("train_start"), F.max(F.when(F.col(RN) <= cut, F.col("day"))).alias("train_end"),
        F.min(F.when(F.col(RN) > cut, F.col("day"))).alias("test_start"), F.max("day").alias("test_end"),
    )
    return out.withColumns({
        "train_sessions": cut, "test_sessions": fact.select("test_sessions").scalar(), "months": fact.select("months").scalar()})


def daily_summary(steps: DataFrame, orders: DataFrame, max_reject: float) -> DataFrame:
    """Profit, exposure, turnover, fees and reject rate per run and day."""
    pnl = steps.select(
        "run_id", "day", (F.col("account_value") - F.coalesce("prev_value", "account_value")).alias("pnl"), "exposure", "turnover",
        F.coalesce("cost", F.lit(0.0)).alias("fees"))
    rejects = orders.groupBy("run_id", "day").agg(F.avg(F.col("rejected").cast("double")).alias("reject_rate"))
    return pnl.join(rejects, ["run_id", "day"], "left").fillna(0.0, ["reject_rate"]).withColumn("reject_ok", F.col("reject_rate") <= max_reject)
