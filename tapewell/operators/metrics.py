"""Performance, trading, safety, regime and mode metrics of rollout steps (``portfolio.rollout``)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapewell.functions.scalars import bank_round
from tapewell.operators.backtest import YEAR, geometric_annual
from tapewell.operators.keyed import RN, drawdown, quantiles, quantiles_beside, rank_buckets
from tapewell.operators.portfolio import RiskLimits
from tapewell.session import checkpointed

MIN_CAGR_STEPS = 252
TOL = 1e-9
EPS = 1e-12

# Category, name, direction and unit of every metric.
METRIC_ROWS = (
    ("performance", "total_return", "higher_is_better", "ratio"),
    ("performance", "cagr", "higher_is_better", "ratio"),
    ("performance", "volatility_ann", "neutral", "ratio"),
    ("performance", "sharpe", "higher_is_better", "ratio"),
    ("performance", "max_drawdown", "lower_is_better", "ratio"),
    ("performance", "calmar", "higher_is_better", "ratio"),
    ("trading", "turnover_1d_mean", "lower_is_better", "ratio"),
    ("trading", "turnover_1d_median", "lower_is_better", "ratio"),
    ("trading", "turnover_1d_std", "lower_is_better", "ratio"),
    ("trading", "turnover_1d_p95", "lower_is_better", "ratio"),
    ("trading", "avg_exposure", "neutral", "ratio"),
    ("trading", "max_concentration", "lower_is_better", "ratio"),
    ("trading", "hhi_mean", "lower_is_better", "ratio"),
    ("trading", "tx_cost_total", "lower_is_better", "currency"),
    ("trading", "tx_cost_bps", "lower_is_better", "bps"),
    ("trading", "avg_cash", "neutral", "ratio"),
    ("safety", "nan_inf_violations", "lower_is_better", "count"),
    ("safety", "action_bounds_violations", "lower_is_better", "count"),
    ("safety", "constraint_violations_count", "lower_is_better", "count"),
    ("safety", "max_weight_violation_count", "lower_is_better", "count"),
    ("safety", "exposure_violation_count", "lower_is_better", "count"),
    ("safety", "turnover_violation_count", "lower_is_better", "count"),
    ("stability", "mode_churn_rate", "lower_is_better", "ratio"),
    ("stability", "mode_set_size", "neutral", "count"),
    ("stability", "cost_curve_span", "lower_is_better", "ratio"),
    ("execution", "summary.fill_rate", "higher_is_better", "ratio"),
    ("execution", "summary.reject_rate", "lower_is_better", "ratio"),
    ("execution", "summary.avg_slippage_bps", "lower_is_better", "bps"),
    ("execution", "summary.p95_slippage_bps", "lower_is_better", "bps"),
    ("execution", "summary.total_fees", "lower_is_better", "currency"),
    ("execution", "summary.turnover_realized", "lower_is_better", "ratio"),
    ("execution", "summary.execution_halts", "lower_is_better", "count"),
    ("execution", "summary.partial_fill_rate", "lower_is_better", "ratio"),
)


def metric_schema(spark: SparkSession) -> DataFrame:
    """The 33 metric definitions as a dimension table."""
    rows = [(f"{category}.{name}", category, name, direction, unit) for category, name, direction, unit in METRIC_ROWS]
    return spark.createDataFrame(rows, "metric_id string, category string, name string, direction string, unit string")


def rounded(df: DataFrame, keys: Sequence[str], places: int = 10) -> DataFrame:
    kinds = dict(df.dtypes)
    return df.select(*[bank_round(c, places).alias(c) if kinds[c] == "double" and c not in keys else F.col(c) for c in df.columns])


def slice_window(steps: DataFrame, start: str, end: str) -> DataFrame:
    """Steps of an evaluation window; its first step becomes step 0, without return, cost or turnover."""
    kept = steps.filter(F.col("day").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    first = kept.groupBy("run_id").agg(F.min("step").alias("_first"))
    out = kept.join(first, "run_id").withColumn("step", F.col("step") - F.col("_first")).drop("_first")
    head = F.col("step") == 0
    return out.withColumns({
        RN: F.col("step") + 1, "ret": F.when(~head, F.col("ret")), "cost": F.when(~head, F.col("cost")),
        "prev_value": F.when(~head, F.col("prev_value")), "turnover": F.when(head, 0.0).otherwise(F.col("turnover")),
    })


def with_drawdown(steps: DataFrame) -> DataFrame:
    """Drawdown from the first value of the (sliced) path."""
    g = steps.drop("drawdown", "peak").withColumn("_g", F.coalesce(F.col("ret") + 1.0, F.lit(1.0)))
    return drawdown(g, ["run_id"], "_g").drop("_g", "equity")


def performance(steps: DataFrame, risk_free: float = 0.0, min_cagr: int = MIN_CAGR_STEPS) -> DataFrame:
    base = steps.groupBy("run_id").agg(
        F.min_by("account_value", "step").alias("_a"), F.max_by("account_value", "step").alias("_z"), F.count("ret").alias("_n"),
        F.avg("ret").alias("_mean"), (F.coalesce(F.stddev_pop("ret"), F.lit(0.0)) * YEAR**0.5).alias("volatility_ann"),
        F.abs(F.min("drawdown")).alias("max_drawdown"),
    )
    ratio = F.try_divide("_z", "_a")
    cagr = F.when((F.col("_n") >= min_cagr) & (F.col("_a") > 0) & (F.col("_z") > 0), F.pow(ratio, F.lit(float(YEAR)) / F.col("_n")) - 1.0)
    out = base.withColumns({
        "total_return": F.coalesce(ratio - 1.0, F.lit(0.0)), "cagr": cagr,
        "sharpe": F.when(F.col("volatility_ann") > 0, (F.col("_mean") * YEAR - risk_free) / F.col("volatility_ann")),
    }).withColumn("calmar", F.when(F.col("max_drawdown") > 0, F.col("cagr") / F.col("max_drawdown")))
    return rounded(out.select("run_id", "total_return", "cagr", "volatility_ann", "sharpe", "max_drawdown", "calmar"), ["run_id"])


def rollout_summary(steps: DataFrame) -> DataFrame:
    """Geometric annual figures on log returns, mean cost, total turnover and final value."""
    base = steps.groupBy("run_id").agg(
        (F.try_divide(F.max_by("account_value", "step"), F.min_by("account_value", "step")) - 1.0).alias("total_return"),
        F.count("ret").alias("num_steps"), (F.coalesce(F.stddev_pop(F.log1p("ret")), F.lit(0.0)) * YEAR**0.5).alias("annualized_vol"),
        F.abs(F.min("drawdown")).alias("max_drawdown"), F.coalesce(F.avg("cost"), F.lit(0.0)).alias("avg_cost"),
        F.sum("turnover").alias("turnover"), F.max_by("account_value", "step").alias("final_value"),
    )
    out = base.withColumn("annualized_return", geometric_annual(F.col("total_return"), F.col("num_steps")))
    return out.withColumn("sharpe_geo", F.coalesce(F.try_divide("annualized_return", "annualized_vol"), F.lit(0.0)))


def trading(steps: DataFrame) -> DataFrame:
    """Turnover, exposure, concentration and cost figures of each run: sums in parts, and beside them the quantiles, for which a
    run's turnovers alone come together."""
    traded = F.when(F.col("step") > 0, F.col("turnover"))
    ranked = quantiles_beside(steps.select("run_id", traded.alias("_t")), ["run_id"], "_t", {"_median": 0.5, "_p95": 0.95})
    middle = ranked.groupBy(F.col("run_id").alias("_run")).agg(
        F.coalesce(F.max("_median"), F.lit(0.0)).alias("turnover_1d_median"), F.coalesce(F.max("_p95"), F.lit(0.0)).alias("turnover_1d_p95"))
    out = steps.groupBy("run_id").agg(
        F.coalesce(F.avg(traded), F.lit(0.0)).alias("turnover_1d_mean"), F.coalesce(F.stddev_pop(traded), F.lit(0.0)).alias("turnover_1d_std"),
        F.avg("exposure").alias("avg_exposure"), F.avg("max_weight").alias("max_concentration"), F.avg("hhi").alias("hhi_mean"),
        F.coalesce(F.sum("cost"), F.lit(0.0)).alias("tx_cost_total"), F.avg("account_value").alias("_acc"),
        F.avg(F.greatest(F.lit(0.0), 1.0 - F.col("exposure"))).alias("avg_cash"),
    ).join(middle, F.col("run_id").eqNullSafe(F.col("_run"))).drop("_run")
    out = out.withColumn("tx_cost_bps", F.coalesce(F.try_divide("tx_cost_total", "_acc") * 1e4, F.lit(0.0))).drop("_acc")
    return rounded(out, ["run_id"])


def _not_finite(c: str):
    return F.isnan(c) | (F.abs(c) == float("inf"))


def safety(steps: DataFrame, weights: DataFrame) -> DataFrame:
    """NaN and infinity counts over values, returns, costs and weights; weights outside [0, 1]."""
    a = steps.groupBy("run_id").agg(
        (F.count_if(_not_finite("account_value")) + F.count_if(_not_finite("ret")) + F.count_if(_not_finite("cost"))).alias("_s"))
    out_of = ~_not_finite("weight") & ((F.col("weight") < -TOL) | (F.col("weight") > 1.0 + TOL))
    b = weights.groupBy("run_id").agg(F.count_if(_not_finite("weight")).alias("_w"), F.count_if(out_of).alias("action_bounds_violations"))
    out = a.join(b, "run_id", "left").fillna(0, ["_w", "action_bounds_violations"])
    return out.select("run_id", (F.col("_s") + F.col("_w")).cast("double").alias("nan_inf_violations"), F.col("action_bounds_violations").cast("double").alias("action_bounds_violations"))


def constraints(positions: DataFrame, limits: RiskLimits, tolerance: float = 1e-12) -> DataFrame:
    """Counts of weights and steps beyond the limits (``portfolio.book`` rows)."""
    w = F.col("weight")
    per = positions.groupBy("run_id", "step").agg(
        F.sum("weight").alias("_t"), F.sum(F.abs(w - F.col("prev_weight"))).alias("_m"),
        (F.count_if(w < -EPS) if limits.long_only else F.lit(0)).alias("_neg"),
        (F.count_if(w > limits.max_weight + EPS) if limits.max_weight is not None else F.lit(0)).alias("_max"),
    )
    return _constraint_counts(per, limits, tolerance)


def path_constraints(path: DataFrame, limits: RiskLimits, tolerance: float = 1e-12) -> DataFrame:
    """``constraints`` of the steps of a ``portfolio.rollout``, each counted out of its own book."""
    def total(f):
        return F.aggregate("book", F.lit(0.0), lambda a, x: a + f(x))

    def hits(f):
        return F.size(F.filter("book", f)).cast("bigint")

    per = path.filter("step > 0").select(
        "run_id", "step", total(lambda x: x["weight"]).alias("_t"), total(lambda x: F.abs(x["weight"] - x["prev_weight"])).alias("_m"),
        (hits(lambda x: x["weight"] < -EPS) if limits.long_only else F.lit(0)).alias("_neg"),
        (hits(lambda x: x["weight"] > limits.max_weight + EPS) if limits.max_weight is not None else F.lit(0)).alias("_max"))
    return _constraint_counts(per, limits, tolerance)


def _constraint_counts(per: DataFrame, limits: RiskLimits, tolerance: float) -> DataFrame:
    cap = limits.total_cap
    over = F.count_if(F.col("_t") > cap + EPS) if cap is not None else F.lit(0)
    fast = F.count_if(F.col("_m") > limits.max_turnover + max(tolerance, EPS)) if limits.max_turnover is not None else F.lit(0)
    out = per.groupBy("run_id").agg(
        F.sum("_neg").alias("_n"), F.sum("_max").cast("double").alias("max_weight_violation_count"),
        over.cast("double").alias("exposure_violation_count"), fast.cast("double").alias("turnover_violation_count"),
    )
    total = F.col("_n") + F.col("max_weight_violation_count") + F.col("exposure_violation_count")
    if limits.max_turnover is not None:
        total = total + F.col("turnover_violation_count")
    return out.withColumn("constraint_violations_count", total.cast("double")).drop("_n")


def median_split(steps: DataFrame, features: Sequence[str]) -> DataFrame:
    """Exposure and turnover below and above the median of each regime feature, and its mean and sd.

    A run's steps come together once for all features.
    """
    rows = steps.select("run_id", "exposure", "turnover", *features)
    parts = []
    for k, f in enumerate(features):
        rows = quantiles_beside(rows, ["run_id"], f, {f"_mid{k}": 0.5})
        low = F.col(f) <= F.col(f"_mid{k}")
        parts += [
            F.avg(F.when(low, F.col("exposure"))).alias(f"el{k}"), F.avg(F.when(~low, F.col("exposure"))).alias(f"eh{k}"),
            F.avg(F.when(low, F.col("turnover"))).alias(f"tl{k}"), F.avg(F.when(~low, F.col("turnover"))).alias(f"th{k}"),
            F.avg(f).alias(f"mean{k}"), F.stddev_pop(f).alias(f"sd{k}"),
        ]
    each = F.explode(F.array(*[
        F.struct(
            F.lit(f).alias("feature"), F.col(f"el{k}").alias("exposure_low"), F.coalesce(f"eh{k}", f"el{k}").alias("exposure_high"), F.col(f"tl{k}").alias("turnover_low"),
            F.coalesce(f"th{k}", f"tl{k}").alias("turnover_high"), F.col(f"mean{k}").alias("feature_mean"), F.col(f"sd{k}").alias("feature_stdev"))
        for k, f in enumerate(features)]))
    out = rows.groupBy("run_id").agg(*parts).select("run_id", each.alias("x")).select("run_id", "x.*").filter(F.col("feature_mean").isNotNull())
    return rounded(out, ["run_id", "feature"])


def mode_summary(steps_modes: DataFrame) -> DataFrame:
    """Per run and mode: steps, mean exposure and turnover, compounded return (steps from 1)."""
    out = steps_modes.filter("step > 0").groupBy("run_id", "mode").agg(
        F.count(F.lit(1)).alias("steps"), F.avg("exposure").alias("exposure"), F.avg("turnover").alias("turnover"),
        (F.product(1.0 + F.col("ret")) - 1.0).alias("performance"),
    )
    return rounded(out, ["run_id", "mode"])


def mode_transitions(steps_modes: DataFrame) -> DataFrame:
    """Counts of consecutive mode pairs ``a->b`` per run, staying included."""
    before = F.lag("mode").over(Window.partitionBy("run_id").orderBy("step"))
    pair = steps_modes.filter("step > 0").select("run_id", "mode", before.alias("_prev"))
    return pair.filter(F.col("_prev").isNotNull()).groupBy("run_id", F.concat("_prev", F.lit("->"), "mode").alias("transition")).agg(F.count(F.lit(1)).alias("n"))


def stability(steps_modes: DataFrame, curve: DataFrame) -> DataFrame:
    """Transitions per step, number of modes and the span of the cost curve."""
    modes = steps_modes.filter("step > 0").groupBy("run_id").agg(F.count(F.lit(1)).alias("_n"), F.count_distinct("mode").cast("double").alias("mode_set_size"))
    moves = mode_transitions(steps_modes).groupBy("run_id").agg(F.sum("n").alias("_m"))
    out = modes.join(moves, "run_id", "left").fillna(0, ["_m"])
    out = out.withColumn("mode_churn_rate", F.col("_m") / F.greatest(F.col("_n") - 1, F.lit(1)))
    return out.join(curve.select("run_id", F.col("span").alias("cost_curve_span")), "run_id").drop("_n", "_m")


COST_MULTIPLES = (0.5, 1.0, 1.5)


def cost_curve(steps: DataFrame) -> DataFrame:
    """Compounded net return with costs at half, full and one and a half times, and their span."""
    rate = F.coalesce(F.try_divide("cost", "prev_value"), F.lit(0.0))
    names = [f"net_{str(m).replace('.', '_')}" for m in COST_MULTIPLES]
    out = steps.filter("step > 0").withColumn("_rate", rate).groupBy("run_id").agg(*[
        (F.product(1.0 + F.col("ret") + F.col("_rate") - m * F.col("_rate")) - 1.0).alias(n) for m, n in zip(COST_MULTIPLES, names)])
    return rounded(out.withColumn("span", F.greatest(*names) - F.least(*names)), ["run_id"])


def regime_performance(labelled: DataFrame, keys: Sequence[str] = ("run_id",)) -> DataFrame:
    """Performance within each label: a step's label goes with its exposure and turnover and with the
    return that follows it.

    A key has a row per day, so its rows come together once; every window and sum lies by ``keys``.
    """
    keys = list(keys)
    path = Window.partitionBy(*keys, "label").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    rows = labelled.select(*keys, "label", "step", "exposure", "turnover", F.lead("ret").over(Window.partitionBy(*keys).orderBy("step")).alias("_next"))
    rows = rows.withColumn("_eq", F.coalesce(F.product(1.0 + F.col("_next")).over(path), F.lit(1.0)))
    rows = rows.withColumn("_dd", F.col("_eq") / F.greatest(F.max("_eq").over(path), F.lit(1.0)) - 1.0)
    paid = F.col("_next").isNotNull()
    out = rows.groupBy(*keys, "label").agg(
        F.avg("exposure").alias("avg_exposure"), F.avg("turnover").alias("avg_turnover"),
        (F.max_by("_eq", F.when(paid, F.col("step"))) - 1.0).alias("total_return"), F.min(F.when(paid, F.col("_dd"))).alias("_low"),
        (F.stddev_pop("_next") * YEAR**0.5).alias("volatility_ann"), F.avg("_next").alias("_mean"),
    ).withColumn("max_drawdown", F.when(F.col("_low").isNotNull(), F.abs(F.least("_low", F.lit(0.0)))))
    out = out.withColumn("sharpe", F.when(F.col("volatility_ann") > 0, F.col("_mean") * YEAR / F.col("volatility_ann"))).drop("_mean", "_low")
    return rounded(out, [*keys, "label"])


def historical_var(steps: DataFrame, levels: Mapping[str, float]) -> DataFrame:
    """Absolute value of the return at rank floor((1 - c) * n) of the sorted returns.

    The rank is an order statistic, so it is read off as an exact quantile without interpolation.
    """
    sized = steps.filter(F.col("ret").isNotNull()).groupBy("run_id", "ret").agg(F.count(F.lit(1)).alias("_c"))
    return order_statistic(sized, ["run_id"], "ret", "_c", {n: 1.0 - c for n, c in levels.items()})


def order_statistic(counted: DataFrame, keys: Sequence[str], value: str, count: str, shares: Mapping[str, float]) -> DataFrame:
    """|value| at rank floor(share * n), clamped, from (value, count) rows, through buckets that the data split."""
    keys = list(keys)

    def ranks(total: Column) -> dict[str, Column]:
        # share * n is rounded at 9 places: (1 - 0.95) * 100 is 5, not 5.000000000000004
        return {n: F.greatest(F.lit(0), F.least(F.floor(F.round(F.lit(s) * total, 9)), total - 1)) for n, s in shares.items()}

    def holds(start: Column, size: Column, total: Column, last: Column) -> Column:
        hit = F.lit(False)
        for r in ranks(total).values():
            hit = hit | ((r >= start) & (r < start + size))
        return hit

    inside = Window.partitionBy(*keys, "_p", "_b").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    rows = rank_buckets(checkpointed(counted), keys, value, count, holds).withColumn("_hi", F.col("_start") + F.sum(count).over(inside))
    return rows.groupBy(*keys).agg(*[
        F.abs(F.min(F.when((r < F.col("_hi")) & (r >= F.col("_hi") - F.col(count)), F.col(value)))).alias(n) for n, r in ranks(F.col("_total")).items()])


def steps_from_payload(payloads: DataFrame) -> DataFrame:
    """Rollout payload arrays to step rows: T+1 values and weights against T returns.

    ``payloads`` has run_id, account_values, returns (arrays) and weights (array of maps); exposure is
    the sum of positive weights, turnover the sum of absolute changes.
    """
    zipped = F.arrays_zip(
        F.col("account_values").alias("value"), F.concat(F.array(F.lit(None).cast("double")), F.col("returns")).alias("ret"),
        F.col("weights").alias("now"), F.concat(F.array(F.lit(None).cast("map<string,double>")), F.col("weights")).alias("before"))
    rows = payloads.select("run_id", F.posexplode(zipped).alias("step", "z")).filter(F.col("z.value").isNotNull())
    now, before = F.coalesce("z.now", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<double>"))), F.col("z.before")
    held = F.aggregate(F.map_values(now), F.lit(0.0), lambda a, x: a + F.greatest(x, F.lit(0.0)))
    names = F.array_union(F.map_keys(now), F.map_keys(before))
    moved = F.aggregate(names, F.lit(0.0), lambda a, k: a + F.abs(F.coalesce(F.try_element_at(now, k), F.lit(0.0)) - F.coalesce(F.try_element_at(before, k), F.lit(0.0))))
    return rows.select("run_id", "step", F.col("z.value").alias("account_value"), F.col("z.ret").alias("ret"), held.alias("exposure"), F.coalesce(moved, F.lit(0.0)).alias("turnover"))
