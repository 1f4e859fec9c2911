"""Comparison of runs, regression and qualification gates, promotion verdicts and sweep summaries."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapewell.functions.scalars import bank_round
from tapewell.operators import metrics as mt
from tapewell.operators.keyed import quantiles

TOL = 1e-9
PAIR = ["candidate", "baseline"]


def long_metrics(*wide: tuple[str, DataFrame]) -> DataFrame:
    """Wide per-run metric frames to (run_id, metric_id, value); non-finite values become null."""
    out = None
    for category, df in wide:
        names = [c for c in df.columns if c != "run_id"]
        part = df.select("run_id", *[F.col(c).cast("double").alias(c) for c in names]).unpivot(["run_id"], names, "name", "value")
        v = F.col("value")
        part = part.select("run_id", F.concat(F.lit(f"{category}."), "name").alias("metric_id"),
                           F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v).alias("value"))
        out = part if out is None else out.unionByName(part)
    return out


def schema_rows() -> list[tuple[str, str, str]]:
    return [(f"{category}.{name}", category, direction) for category, name, direction, _ in mt.METRIC_ROWS]


def _literal_rows(names: Sequence[str], rows: Sequence[tuple]) -> Column:
    """A small fixed table as an array to explode beside each row."""
    return F.explode(F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, r)]) for r in rows]))


def _side(values: DataFrame, side: str, keys: Sequence[str]) -> DataFrame:
    return values.select(F.col("run_id").alias(side), *keys, F.col("value").alias(f"{side}_value"))


def deltas(rows: DataFrame) -> DataFrame:
    """Difference and percent difference of candidate and baseline values."""
    c, b = F.col("candidate_value"), F.col("baseline_value")
    raw = c - b
    return rows.withColumn("delta", bank_round(raw, 10)).withColumn("delta_pct", F.when(F.abs(b) > TOL, bank_round(raw / b * 100.0, 6)))


def compare(metrics: DataFrame, pairs: DataFrame, only: Sequence[str] | None = None) -> DataFrame:
    """Every schema metric of each (candidate, baseline) pair with its delta, status and missing reason.

    Metrics without a preferred direction count as higher-is-better.
    """
    rows = [r for r in schema_rows() if only is None or r[0] in set(only)]
    asked = pairs.select(*PAIR, _literal_rows(["metric_id", "category", "direction"], rows).alias("m")).select(*PAIR, "m.*")
    out = asked.join(_side(metrics, "candidate", ["metric_id"]), ["candidate", "metric_id"], "left")
    out = deltas(out.join(_side(metrics, "baseline", ["metric_id"]), ["baseline", "metric_id"], "left"))
    c, b = F.col("candidate_value").isNull(), F.col("baseline_value").isNull()
    d = F.col("candidate_value") - F.col("baseline_value")
    better = F.when(F.col("direction") == "lower_is_better", d < 0).otherwise(d > 0)
    status = F.when(d.isNull() | (F.abs(d) <= TOL), "unchanged").when(better, "improved").otherwise("regressed")
    reason = F.when(c & b, "candidate_and_baseline_missing").when(c, "candidate_missing").when(b, "baseline_missing")
    return out.withColumn("status", status).withColumn("reason", reason)


def compare_buckets(values: DataFrame, pairs: DataFrame) -> DataFrame:
    """Per bucket and metric: both values and their delta; ``values`` has run_id, bucket, metric, value."""
    k = ["bucket", "metric"]
    left = pairs.join(_side(values, "candidate", k), "candidate")
    right = pairs.join(_side(values, "baseline", k), "baseline")
    return deltas(left.join(right, [*PAIR, *k], "full"))


# -- regression gates ------------------------------------------------------------------------

# The default gates (id, metric, type, max degradation in percent, max value).
DEFAULT_GATES = (
    ("sharpe_guard", "performance.sharpe", "hard", 5.0, None),
    ("drawdown_guard", "performance.max_drawdown", "soft", 10.0, None),
    ("turnover_guard", "trading.turnover_1d_mean", "soft", 15.0, None),
    ("nan_inf_guard", "safety.nan_inf_violations", "hard", None, 0.0),
)


def regression_gates(comparison: DataFrame, pairs: DataFrame, gates: Sequence[tuple] = DEFAULT_GATES) -> DataFrame:
    """Status of each gate per pair: a hard gate violated fails, a soft one warns; a metric that is
    missing is a violation."""
    rules = [(i, m, kind, None if p is None else float(p), None if x is None else float(x)) for i, m, kind, p, x in gates]
    arr = F.explode(F.array(*[
        F.struct(F.lit(i).alias("gate_id"), F.lit(m).alias("metric_id"), F.lit(k).alias("gate_type"), F.lit(p).cast("double").alias("max_pct"), F.lit(x).cast("double").alias("max_value"))
        for i, m, k, p, x in rules]))
    out = pairs.select(*PAIR, arr.alias("g")).select(*PAIR, "g.*").join(comparison, [*PAIR, "metric_id"], "left")
    c, b = F.col("candidate_value"), F.col("baseline_value")
    worse = F.greatest(F.lit(0.0), F.when(F.col("direction") == "lower_is_better", c - b).otherwise(b - c))
    out = out.withColumn("degradation", worse)
    pct = F.when(F.abs(b) > TOL, bank_round(F.col("degradation") / F.abs(b) * 100.0, 6)).when(F.col("degradation") <= TOL, 0.0)
    over_pct = F.col("max_pct").isNotNull() & (F.col("degradation") > F.abs(b) * F.col("max_pct") / 100.0 + TOL)
    over_max = F.col("max_value").isNotNull() & (c > F.col("max_value") + TOL)
    absent = F.col("direction").isNull() | F.col("reason").isNotNull()
    bad = absent | F.coalesce(over_pct | over_max, F.lit(False))
    status = F.when(~bad, "pass").when(F.col("gate_type") == "hard", "fail").otherwise("warn")
    return out.withColumn("degradation_pct", pct).withColumn("status", status)


def gate_report(evaluated: DataFrame) -> DataFrame:
    return evaluated.groupBy(*PAIR).agg(
        F.count_if(F.col("status") == "fail").alias("hard_failures"), F.count_if(F.col("status") == "warn").alias("soft_warnings"),
    ).withColumn("overall_status", F.when(F.col("hard_failures") > 0, "fail").otherwise("pass"))


def gate_tally(evaluated: DataFrame) -> DataFrame:
    return evaluated.groupBy("gate_id").pivot("status", ["pass", "fail", "warn"]).agg(F.count(F.lit(1))).fillna(0)


# -- qualification gates ---------------------------------------------------------------------


def _spread(rows: DataFrame, key: str, names: Sequence[str]) -> DataFrame:
    """Candidate and baseline values of some metrics side by side, one row per pair."""
    cells = []
    for n in names:
        short = n.replace(".", "_")
        for side in ("candidate", "baseline"):
            cells.append(F.max(F.when(F.col(key) == n, F.col(f"{side}_value"))).alias(f"{side[0]}_{short}"))
    return rows.groupBy(*PAIR).agg(*cells)


def _reasons(df: DataFrame, rules: Sequence[tuple[str, Column]]) -> DataFrame:
    """One row per pair, reason and severity that applies; rules are (severity, reason column)."""
    items = F.array(*[F.when(r.isNotNull(), F.struct(F.lit(s).alias("severity"), r.alias("reason"))) for s, r in rules])
    return df.select(*PAIR, F.explode(F.array_compact(items)).alias("x")).select(*PAIR, "x.*")


def measured(value: Column, places: int = 10) -> Column:
    """A number as reasons carry it: rounded, without trailing zeros."""
    return F.regexp_replace(F.format_string(f"%.{places}f", value), r"(\.\d+?)0+$", "$1")


def regime_gates(regime: DataFrame, comparison: DataFrame, modes: DataFrame | None = None) -> DataFrame:
    """Reasons a candidate fails in high volatility: drawdown (10 % worse, 2 points worse), exposure
    (cap 0.40 and baseline), Sharpe (-15 %) and turnover (+20 %), and mode churn (over 10 % of steps).

    ``modes`` has candidate, steps, transitions, defensive_share; without it the mode rules are off.
    """
    high = _spread(regime.filter(F.col("bucket") == "high_vol"), "metric", ["max_drawdown", "avg_exposure", "avg_turnover"])
    sharpe = _spread(comparison, "metric_id", ["performance.sharpe"])
    df = sharpe.join(high, PAIR, "left")
    cd, bd = F.col("c_max_drawdown"), F.col("b_max_drawdown")
    ce, be = F.col("c_avg_exposure"), F.col("b_avg_exposure")
    ct, bt = F.col("c_avg_turnover"), F.col("b_avg_turnover")
    cs, bs = F.col("c_performance_sharpe"), F.col("b_performance_sharpe")
    drop, rise = (bs - cs) / bs * 100.0, (ct - bt) / bt * 100.0
    rules = [
        ("hard", F.when(cd.isNull() | bd.isNull(), "regime_high_vol_drawdown_missing").when(cd > bd * 1.10 + TOL, "regime_high_vol_drawdown_regressed")),
        ("hard", F.when(cd > bd + 0.02 + TOL, "execution_high_vol_drawdown_regressed")),
        ("soft", F.when(cs.isNull() | bs.isNull() | (bs <= TOL), "regime_sharpe_missing").when((bs - cs > TOL) & (drop > 15.0 + TOL), "regime_sharpe_degradation")),
        ("soft", F.when(ct.isNull() | bt.isNull() | (bt <= TOL), "regime_high_vol_turnover_missing").when((ct - bt > TOL) & (rise > 20.0 + TOL), "regime_high_vol_turnover_spike")),
    ]
    if modes is not None:
        df = df.join(modes, "candidate", "left")
        n, m, share = F.col("steps"), F.col("transitions"), F.col("defensive_share")
        limit = F.least(F.lit(0.40), F.coalesce(be, F.lit(0.40)))
        rules += [
            ("hard", F.when(ce.isNull(), "regime_high_vol_exposure_missing").when(ce > limit + TOL, "regime_high_vol_exposure_exceeded")),
            ("soft", F.when(F.coalesce(n, F.lit(0)) <= 0, "hierarchy_mode_counts_missing").when(m > F.ceil(n * 0.10) + TOL, "hierarchy_mode_transitions_exceeded")),
            ("soft", F.when(n > 0, F.when(share <= TOL, "hierarchy_never_defensive").when(share >= 1.0 - TOL, "hierarchy_always_defensive"))),
        ]
    return _reasons(df, rules)


EXECUTION_METRICS = tuple(f"execution.summary.{m}" for m in (
    "execution_halts", "reject_rate", "fill_rate", "p95_slippage_bps", "avg_slippage_bps", "total_fees", "turnover_realized"))


def execution_gates(
    comparison: DataFrame, *, min_fill: float = 0.99, max_reject: float = 0.01, max_p95: float = 25.0, slippage_delta: float = 5.0,
    fees_pct: float = 10.0, turnover_pct: float = 10.0,
) -> DataFrame:
    """Reasons on execution quality: hard caps on halts, rejects, fills and p95 slippage; soft limits on
    the drift of slippage, fees and turnover; a Sharpe drop that comes with more slippage.  A candidate without any of
    these metrics has one reason only."""
    df = _spread(comparison, "metric_id", [*EXECUTION_METRICS, "performance.sharpe"])

    def c(m: str) -> Column:
        return F.col(f"c_execution_summary_{m}")

    def b(m: str) -> Column:
        return F.col(f"b_execution_summary_{m}")

    some = F.coalesce(*[F.col("c_" + m.replace(".", "_")) for m in EXECUTION_METRICS]).isNotNull()

    def hard(m: str, bad: Column, reason: str) -> tuple[str, Column]:
        return "hard", F.when(some & c(m).isNull(), f"missing_execution_metric:execution.summary.{m}").when(bad, reason)

    def drift(m: str, limit: float, percent: bool) -> tuple[str, Column]:
        d = c(m) - b(m)
        d = F.when(F.abs(b(m)) > TOL, d / b(m) * 100.0) if percent else d
        return "soft", F.when(d > limit + TOL, f"execution.summary.{m}_regressed")

    worse = (F.col("c_performance_sharpe") - F.col("b_performance_sharpe") < -TOL) & (c("avg_slippage_bps") - b("avg_slippage_bps") > TOL)
    return _reasons(df, [
        ("hard", F.when(~some, "execution_metrics_missing")),
        hard("execution_halts", c("execution_halts") > TOL, "execution_halts_detected"),
        hard("reject_rate", c("reject_rate") > max_reject + TOL, "execution_reject_rate_exceeded"),
        hard("fill_rate", c("fill_rate") < min_fill - TOL, "execution_fill_rate_below_minimum"),
        hard("p95_slippage_bps", F.abs(c("p95_slippage_bps")) > max_p95 + TOL, "execution_slippage_exceeded"),
        drift("avg_slippage_bps", slippage_delta, False), drift("total_fees", fees_pct, True), drift("turnover_realized", turnover_pct, True),
        ("soft", F.when(worse, "execution_sharpe_correlated_with_slippage")),
    ])


def base_gates(comparison: DataFrame, report: DataFrame, *, max_drawdown: float = 1.0, max_turnover: float = 1.0, places: int = 10) -> DataFrame:
    """Reasons from regression gates, constraint counts, sanity limits, Sharpe and stability, with the measured values."""
    counts = ("constraint_violations_count", "max_weight_violation_count", "exposure_violation_count", "turnover_violation_count")
    stable = ("mode_churn_rate", "cost_curve_span")
    names = [*[f"safety.{m}" for m in (*counts, "nan_inf_violations")], "performance.max_drawdown", "trading.turnover_1d_mean", "performance.sharpe", "trading.turnover_1d_std", *[f"stability.{m}" for m in stable]]
    df = _spread(comparison, "metric_id", names).join(report, PAIR)

    def c(m: str) -> Column:
        return F.col("c_" + m.replace(".", "_"))

    def b(m: str) -> Column:
        return F.col("b_" + m.replace(".", "_"))

    first = F.coalesce(*[
        F.when(c(f"safety.{m}").isNull(), f"missing_metric:safety.{m}").when(
            c(f"safety.{m}") > 0, F.concat(F.lit(f"constraint_violation:{m}="), measured(c(f"safety.{m}"), places))) for m in counts])
    nan, dd, turn = c("safety.nan_inf_violations"), c("performance.max_drawdown"), c("trading.turnover_1d_mean")
    cs, bs = c("performance.sharpe"), b("performance.sharpe")
    return _reasons(df, [
        ("hard", F.when(F.col("overall_status") == "fail", "regression_gates_failed")),
        ("soft", F.when((F.col("overall_status") != "fail") & (F.col("soft_warnings") > 0), "regression_gates_soft_warnings")),
        ("hard", first),
        ("hard", F.when(nan.isNull(), "missing_metric:safety.nan_inf_violations").when(nan > 0, "sanity:nan_inf_detected")),
        ("hard", F.when(dd.isNull(), "missing_metric:performance.max_drawdown").when(dd > max_drawdown + TOL, F.concat(F.lit("sanity:max_drawdown_exceeded:"), measured(dd, places)))),
        ("hard", F.when(turn.isNull(), "missing_metric:trading.turnover_1d_mean").when(turn > max_turnover + TOL, F.concat(F.lit("sanity:turnover_exceeded:"), measured(turn, places)))),
        ("soft", F.when(cs.isNull() | bs.isNull(), "soft_gate:sharpe_missing").when(cs + TOL < bs, F.concat(F.lit("soft_gate:sharpe_not_improved:"), measured(cs - bs, places)))),
        ("soft", F.when(c("trading.turnover_1d_std") > b("trading.turnover_1d_std") + TOL, "stability_regressed:turnover_std")),
        *[("soft", F.when(c(f"stability.{m}") > b(f"stability.{m}") + TOL, f"stability_regressed:{m}")) for m in stable],
    ])


def high_vol_gates(regime: DataFrame, pairs: DataFrame, tolerance: float = TOL) -> DataFrame:
    """Neither drawdown nor exposure in high volatility may exceed the baseline's."""
    rows = regime.filter(F.col("bucket") == "high_vol")
    df = pairs.select(*PAIR).join(_spread(rows, "metric", ["max_drawdown", "avg_exposure"]), PAIR, "left")
    cd, bd, ce, be = (F.col(c) for c in ("c_max_drawdown", "b_max_drawdown", "c_avg_exposure", "b_avg_exposure"))
    return _reasons(df, [
        ("hard", F.when(cd.isNull() | bd.isNull() | ce.isNull() | be.isNull(), "regime_high_vol_metrics_missing")),
        ("hard", F.when(cd > bd + tolerance, "regime_high_vol_drawdown_regressed")),
        ("hard", F.when(ce > be + tolerance, "regime_high_vol_exposure_increased")),
    ])


def artifact_gates(pairs: DataFrame, present: DataFrame, required: Sequence[str]) -> DataFrame:
    """Required artifacts a candidate lacks; ``present`` has run_id and artifact."""
    want = pairs.select(*PAIR, F.explode(F.array(*[F.lit(a) for a in required])).alias("artifact"))
    gone = want.join(present.select(F.col("run_id").alias("candidate"), "artifact").distinct(), ["candidate", "artifact"], "left_anti")
    named = F.concat(F.lit("missing_artifacts:"), F.array_join(F.array_sort(F.collect_set("artifact")), ","))
    return gone.groupBy(*PAIR).agg(named.alias("reason")).select(*PAIR, F.lit("hard").alias("severity"), "reason")


# Fixed value: the note on a run compared with itself.
SAME_RUN = "Baseline equals candidate; delta-based gates skipped (Phase 1 mode)."


def presence_gates(pairs: DataFrame, execution: DataFrame, returns: DataFrame) -> DataFrame:
    """Missing baseline execution metrics, missing replays and runs compared with themselves.

    ``execution`` has run_id and replayed (its state and summary were kept with it) of every run with execution metrics;
    ``returns`` has run_id and value, one row a step.  A run can be replayed if it has returns, all finite, or such an
    execution.  A missing execution of the candidate is a reason of ``execution_gates``.
    """
    v = F.col("value").cast("double")
    finite = v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    whole = returns.groupBy(F.col("run_id").alias("candidate")).agg(F.bool_and(finite).alias("whole"))
    kept = execution.groupBy("run_id").agg(F.bool_or(F.coalesce("replayed", F.lit(False))).alias("kept"))
    df = pairs.select(*PAIR).join(whole, "candidate", "left")
    df = df.join(kept.withColumnRenamed("run_id", "candidate"), "candidate", "left")
    df = df.join(kept.select(F.col("run_id").alias("baseline"), F.lit(True).alias("found")), "baseline", "left")
    replay = F.coalesce("whole", F.lit(False)) | F.coalesce("kept", F.lit(False))
    same = F.col("candidate") == F.col("baseline")
    return _reasons(df, [
        ("soft", F.when(F.col("found").isNull(), "execution_baseline_metrics_missing")),
        ("hard", F.when(~replay, "deterministic_replay_missing")), ("soft", F.when(same, SAME_RUN))])


def sweep_gates(
    pairs: DataFrame, sweeps: DataFrame, *, min_completed: int | None = None, max_failures: int | None = None, severity: str = "soft",
    names: DataFrame | None = None,
) -> DataFrame:
    """Robustness of the sweep a candidate belongs to; ``sweeps`` has candidate, completed, fails of the summaries that
    exist, ``names`` candidate and sweep.  A missing summary is a soft reason whatever the severity."""
    df = pairs.select(*PAIR).join(sweeps.withColumn("summary", F.lit(True)), "candidate", "left")
    df = df.withColumn("sweep", F.lit(None).cast("string")) if names is None else df.join(names, "candidate", "left")
    done, fails = F.coalesce("completed", F.lit(0)), F.coalesce("fails", F.lit(0))
    missing = F.col("summary").isNull()
    low = F.lit(False) if min_completed is None else done < min_completed
    high = F.lit(False) if max_failures is None else fails > max_failures
    text = lambda reason, value, sign, limit: F.concat(F.lit(reason), value.cast("string"), F.lit(f"{sign}{limit}"))
    return _reasons(df, [
        ("soft", F.when(missing, F.concat_ws(":", F.lit("sweep_summary_missing"), "sweep"))),
        (severity, F.when(~missing, F.when(low, text("sweep_completed_below_threshold:", done, "<", min_completed)).when(high, text("sweep_failures_exceeded:", fails, ">", max_failures))))])


def mode_gates(pairs: DataFrame, mode_counts: DataFrame, *, min_modes: int = 0, min_share: float = 0.0, severity: str = "soft", places: int = 10) -> DataFrame:
    """Fewest active modes and smallest share of any mode; ``mode_counts`` has run_id, mode, steps.  The first mode by
    name below the share is the one named."""
    steps = F.greatest(F.col("steps"), F.lit(0))
    counts = mode_counts.filter("steps is not null").groupBy(F.col("run_id").alias("candidate"), "mode").agg(F.sum(steps).alias("steps"))
    total = counts.groupBy("candidate").agg(F.sum("steps").alias("total"), F.count_if(F.col("steps") > 0).alias("active"))
    share = F.col("steps") / F.col("total")
    rare = counts.join(total, "candidate").filter((F.col("total") > 0) & (share < min_share)).groupBy("candidate").agg(F.min(F.struct("mode", share.alias("share"))).alias("rare"))
    df = pairs.select(*PAIR).join(total, "candidate", "left").join(rare, "candidate", "left")
    named = F.concat(F.lit("regime_mode_fraction_below_threshold:"), F.col("rare.mode"), F.lit(":"), measured(F.col("rare.share"), places), F.lit(f"<{min_share}"))
    few = F.concat(F.lit("regime_active_modes_below_threshold:"), F.col("active").cast("string"), F.lit(f"<{min_modes}"))
    return _reasons(df, [(severity, F.when(F.col("active").isNull(), "regime_mode_counts_missing").when(F.col("active") < min_modes, few)
                          .when(F.col("total") <= 0, "regime_mode_counts_empty").when(F.col("rare").isNotNull(), named))])


def verdict(pairs: DataFrame, *reasons: DataFrame) -> DataFrame:
    """Hard and soft reasons per pair, sorted; passed without a hard one."""
    rows = reasons[0]
    for r in reasons[1:]:
        rows = rows.unionByName(r)

    def listed(severity: str) -> Column:
        return F.array_join(F.array_sort(F.collect_set(F.when(F.col("severity") == severity, F.col("reason")))), ",")

    got = rows.groupBy(*PAIR).agg(listed("hard").alias("failed_hard"), listed("soft").alias("failed_soft"))
    out = pairs.select(*PAIR).join(got, PAIR, "left").fillna("", ["failed_hard", "failed_soft"])
    return out.withColumn("passed", F.col("failed_hard") == "")


# -- sweeps ----------------------------------------------------------------------------------


def sweep_summary(metrics: DataFrame, directions: Mapping[str, str]) -> DataFrame:
    """Samples, mean, median, deviation and the best and worst run per metric; ties to the lowest run."""
    rows = metrics.filter(F.col("metric_id").isin(list(directions)) & F.col("value").isNotNull())
    lower = F.col("metric_id").isin([m for m, d in directions.items() if d == "lower_is_better"])
    score = F.when(lower, -F.col("value")).otherwise(F.col("value"))
    med = quantiles(rows, ["metric_id"], "value", {"median": 0.5})
    out = rows.withColumn("_s", score).groupBy("metric_id").agg(
        F.count(F.lit(1)).alias("samples"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"),
        F.max_by("run_id", F.struct("_s", -F.col("run_id"))).alias("best_run"), F.min_by("run_id", F.struct("_s", "run_id")).alias("worst_run"),
    )
    return out.join(med, "metric_id")


def sweep_regimes(buckets: DataFrame, lower: Sequence[str] = ("max_drawdown",)) -> DataFrame:
    """Mean, variance and worst run per bucket and metric over all runs."""
    score = F.when(F.col("metric").isin(list(lower)), -F.col("value")).otherwise(F.col("value"))
    rows = buckets.filter(F.col("value").isNotNull()).withColumn("_s", score)
    return rows.groupBy("bucket", "metric").agg(
        F.count(F.lit(1)).alias("samples"), F.avg("value").alias("mean"), F.var_pop("value").alias("variance"),
        F.min_by("run_id", F.struct("_s", "run_id")).alias("worst_run"))


def configuration_counts(runs: DataFrame, dimensions: Sequence[str]) -> DataFrame:
    """Runs per combination of dimension values and all partial combinations."""
    return runs.cube(*dimensions).agg(F.count(F.lit(1)).alias("samples"), F.grouping_id(*dimensions).alias("level"))


def expand_sweep(bases: DataFrame, dimensions: Sequence[str]) -> DataFrame:
    """Every combination of the list-valued columns, unrolled in sorted order of their names."""
    out = bases
    for d in sorted(dimensions):
        out = out.withColumn(d, F.explode(d))
    return out


def grid(start: Column, step: Column, count: Column) -> Column:
    """start, start + step, ... (count values)."""
    return F.transform(F.sequence(F.lit(0), count - 1), lambda i: start + i * step)


def win_table(comparison: DataFrame) -> DataFrame:
    """Ticks for the better side of each metric: one per 20 % of relative improvement, at least one."""
    m = F.lower("metric_id")
    lower = F.lit(False)
    for token in ("drawdown", "volatility", "turnover", "cost", "fee", "slippage"):
        lower = lower | m.contains(token)
    c, b = F.col("candidate_value"), F.col("baseline_value")
    gain = F.when(lower, b - c).otherwise(c - b) / F.nullif(F.abs(b), F.lit(0.0))

    def ticks(g: Column) -> Column:
        n = sum((F.when(g >= t, 1).otherwise(0) for t in (0.4, 0.6, 0.8, 1.0)), F.lit(1))
        return F.when(g > 0, n).otherwise(0)

    return comparison.filter(c.isNotNull() & b.isNotNull()).select(*PAIR, "metric_id", F.coalesce(ticks(gain), F.lit(0)).alias("candidate_ticks"), F.coalesce(ticks(-gain), F.lit(0)).alias("baseline_ticks"))
