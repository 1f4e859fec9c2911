"""Hand-computed values of single operators."""

import math

import pytest
from pyspark.sql import functions as F

from tapewell.operators import execution as ex, features as ft, fundamentals as fu, governance as gv, health, metrics as mt
from tapewell.operators import portfolio as pf, reconcile as rc, regimes as rg, stress as st
from tapewell.operators.calendars import complete_panel, missing_ranges, union_calendar
from tapewell.sources import sinks

DAY = 86_400


def bars(spark, series, start="2024-01-01"):
    rows = [(s, i, float(c), 1e6 + 1e4 * i) for s, closes in series.items() for i, c in enumerate(closes)]
    df = spark.createDataFrame(rows, "symbol string, i int, close double, volume double")
    return df.select("symbol", F.date_add(F.lit(start).cast("date"), F.col("i")).cast("timestamp").alias("ts"), "close", "volume", "i")


def by_index(df, *cols):
    return [tuple(r) for r in df.orderBy("i").select(*cols).collect()]


def test_core_features(spark, small_chunks):
    closes = [100 + 50 * i / 79 for i in range(80)]
    out = by_index(ft.core_v1(ft.numbered_bars(bars(spark, {"A": closes}), DAY)), "ret_1", "rv_21", "rv_63", "dist_from_20d_low")
    assert out[0][0] == 0.0 and out[5][0] == pytest.approx(math.log(closes[5] / closes[4]))
    assert all(r[1] == 0 for r in out[:21]) and out[21][1] > 0
    assert all(r[2] == 0 for r in out[:63]) and out[63][2] > 0
    assert all(r[3] == 0 for r in out[:19]) and out[19][3] == pytest.approx(closes[19] / closes[0] - 1)


def test_labels(spark):
    b = ft.numbered_bars(bars(spark, {"A": [100, 101, 98, 99, 105]}), DAY)
    out = by_index(ft.forward_labels(b, (1, 2), (2,)), "label_fwd_return_1", "label_fwd_return_2", "label_fwd_drawdown_2")
    assert out[0][0] == pytest.approx(0.01) and out[0][1] == pytest.approx(-0.02) and out[4][0] == 0
    assert out[0][2] == pytest.approx(-0.02) and out[3][2] == 0
    labels = b.withColumn("label", F.element_at(F.array(*[F.lit(x) for x in ("low", "low", "high", "high", "low")]), F.col("i") + 1))
    flags = by_index(ft.transition_flags(labels, ["symbol"], "label"), "label_regime_transition_1")
    assert [f[0] for f in flags] == [0, 1, 0, 1, 0]


def test_cross_section(spark):
    panel = complete_panel(bars(spark, {"AAA": [100, 110, 115.5], "BBB": [50, 45, 47.7], "CCC": [80, 84, 79.8]}), DAY)
    out = ft.equity_xsec_v1(panel)
    last = {r.symbol: r for r in out.filter("ts = '2024-01-03'").collect()}
    assert (last["CCC"].ret_1d_rank, last["AAA"].ret_1d_rank, last["BBB"].ret_1d_rank) == (0.0, 0.5, 1.0)
    assert last["AAA"].ret_5d_z == 0.0 and last["AAA"].corr_spike_20d == 0.0
    pdf = out.toPandas().pivot(index="ts", columns="symbol", values="ret_1d")
    corr = pdf.corr().to_numpy()
    assert last["AAA"].corr_mean_20d == pytest.approx((corr[0, 1] + corr[0, 2] + corr[1, 2]) / 3)


def test_regime_is_market_recomputed(spark):
    panel = complete_panel(bars(spark, {"A": [10, 11, 12, 11, 13, 12], "B": [20, 19, 21, 22, 20, 23], "C": [5, 5.5, 5.2, 5.6, 5.8, 5.1]}), DAY)
    got = ft.regime_v1(panel).orderBy("ts").toPandas()
    p = panel.toPandas().pivot(index="ts", columns="symbol", values="close").pct_change().fillna(0.0)
    m = p.mean(axis=1)
    assert got["market_vol_20d"].tolist() == pytest.approx(m.rolling(20, min_periods=2).std(ddof=0).fillna(0).tolist())
    assert got["dispersion_20d"].tolist() == pytest.approx(p.std(axis=1, ddof=0).rolling(20, min_periods=1).mean().tolist())


def run_steps(spark):
    values, costs = [100.0, 110.0, 105.0, 120.0], [None, 1.0, 0.5, 0.0]
    weights = [(0.5, 0.0), (0.6, 0.2), (0.4, 0.4), (0.6, 0.2)]
    rows, peak = [], 0.0
    for i, (v, c, w) in enumerate(zip(values, costs, weights)):
        prev = values[i - 1] if i else None
        peak = max(peak, v)
        turn = sum(abs(a - b) for a, b in zip(w, weights[i - 1])) if i else 0.0
        rows.append((1, i, i + 1, v, prev, v / prev - 1 if i else None, c, turn, sum(w), max(w), sum(x * x for x in w), v / peak - 1))
    return spark.createDataFrame(rows, "run_id bigint, step bigint, _rn bigint, account_value double, prev_value double, ret double, cost double, turnover double, exposure double, max_weight double, hhi double, drawdown double")


def test_performance(spark):
    r = mt.performance(run_steps(spark)).first()
    assert r.total_return == pytest.approx(0.2) and r.volatility_ann == pytest.approx(1.279352, abs=1e-6)
    assert r.sharpe == pytest.approx(12.961107, abs=1e-6) and r.max_drawdown == pytest.approx(0.045455, abs=1e-6) and r.cagr is None


def test_trading(spark):
    r = mt.trading(run_steps(spark)).first()
    assert r.turnover_1d_mean == pytest.approx(1.1 / 3) and r.turnover_1d_median == pytest.approx(0.4)
    assert r.tx_cost_total == pytest.approx(1.5) and r.tx_cost_bps == pytest.approx(137.931034, abs=1e-6)


def test_projection(spark):
    w = spark.createDataFrame([(1, 1, "A", 0.9), (1, 1, "B", 0.2), (1, 2, "A", -0.3), (1, 2, "B", 1e-14)], "run_id bigint, step bigint, symbol string, weight double")
    got = {(r.step, r.symbol): r.weight for r in pf.project(w, pf.RiskLimits(max_weight=0.4)).collect()}
    assert got == {(1, "A"): 0.4, (1, "B"): 0.2, (2, "A"): 0.0, (2, "B"): 0.0}


def test_turnover_cap_in_chunks(spark, small_chunks):
    rows = [(1, s, "A", 1.0 if s % 3 else 0.1) for s in range(1, 24)]
    w = spark.createDataFrame(rows, "run_id bigint, step bigint, symbol string, weight double")
    got = {r.step: r.weight for r in pf.cap_turnover(w, pf.RiskLimits(max_turnover=0.3)).collect()}
    prev = 0.0
    for s in range(1, 24):
        target = 1.0 if s % 3 else 0.1
        prev = target if abs(target - prev) <= 0.3 else prev + math.copysign(0.3, target - prev)
        assert got[s] == pytest.approx(prev)


def test_mode_hold_in_chunks(spark, small_chunks):
    vol = [0.9, 0.1, 0.1, 0.9, 0.1, 0.1, 0.1, 0.9, 0.9, 0.1, 0.9, 0.1]
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate(vol)], "run_id bigint, step bigint, vol double").withColumns({
        "trend": F.lit(0.0), "dispersion": F.lit(0.0), "day": F.date_add(F.lit("2024-01-01").cast("date"), F.col("step").cast("int"))})
    got = [r.mode for r in pf.select_modes(df, pf.ModeRule(0.5, 1.0, 1.0, min_hold=3)).orderBy("step").collect()]
    mode, changed, want = None, 0, []
    for i, v in enumerate(vol):
        m = "defensive" if v >= 0.5 else "neutral"
        if mode is None or (m != mode and i - changed >= 3):
            mode, changed = m, i
        want.append(mode)
    assert got == want


def test_rollout_accounting(spark):
    t = spark.createDataFrame([(1, "2024-01-01", "A", 0.5), (1, "2024-01-02", "A", 0.5), (1, "2024-01-03", "B", 0.4)], "run_id bigint, d string, symbol string, weight double").withColumn("day", F.to_date("d")).drop("d")
    r = spark.createDataFrame([("A", "2024-01-02", 0.1), ("B", "2024-01-03", -0.2)], "symbol string, d string, ret double").withColumn("day", F.to_date("d")).drop("d")
    out = pf.rollout(t, r, 100.0).orderBy("step").collect()
    v1 = (1 - 0.01 * 0.5) * 1.05
    v2 = v1 * (1 - 0.01 * 0.9) * (1 - 0.08)
    assert [x.account_value for x in out] == pytest.approx([1.0, v1, v2]) and out[2].turnover == pytest.approx(0.9)


def test_band_and_order_types(spark):
    hi, lo = ex.effective_band(F.lit(110.0), F.lit(90.0), 0.15, 0.0)
    assert tuple(spark.range(1).select(hi, lo).first()) == pytest.approx((108.5, 91.5))
    rows = [("limit", 0.0, 1.0, 0.05), ("stop_loss", 1.0, 0.0, 0.15), ("trailing_stop", 1.0, 0.0, 0.2), ("stop_loss", 0.0, 1.0, 0.5)]
    df = spark.createDataFrame(rows, "order_type string, prev_weight double, target double, offset double").withColumns({
        "close": F.lit(100.0), "next_open": F.lit(99.0), "next_high": F.lit(110.0), "next_low": F.lit(90.0), "anchor": F.lit(115.0)})
    got = [(r.kind, r.filled, r.fill_price) for r in ex.fill_orders(df).collect()]
    assert got == [("limit", True, 95.0), ("stop_loss", False, 85.0), ("trailing_stop", True, 92.0), ("market", True, 99.0)]


def test_greedy_cash(spark):
    rows = [(1, 1, "A", 0.0, 10.0, 0.5, 100.0), (1, 1, "B", 0.0, 30.0, 0.4, 100.0), (1, 1, "C", 2.0, 20.0, 0.0, 100.0)]
    df = spark.createDataFrame(rows, "run_id bigint, step bigint, symbol string, holding double, price double, weight double, value double")
    cash = spark.createDataFrame([(1, 1, 5.0)], "run_id bigint, step bigint, cash double")
    got = {r.symbol: (r.side, r.filled_qty, r.reason) for r in ex.fund_buys(ex.order_candidates(df), cash).collect()}
    assert got == {"A": ("BUY", 4.0, "partial_fill_due_to_cash"), "B": ("BUY", 0.0, "insufficient_cash"), "C": ("SELL", 2.0, None)}


def test_weighted_quantile(spark):
    df = spark.createDataFrame([("r", -3.0, 1.0), ("r", 2.0, 5.0), ("r", 9.0, 3.0), ("r", 30.0, 1.0)], "k string, v double, w double")
    assert ex.weighted_quantile(df, ["k"], "v", "w", 0.9, "q").first().q == 9.0
    assert ex.weighted_quantile(df, ["k"], "v", "w", 0.95, "q").first().q == 30.0


def test_value_at_risk(spark):
    df = spark.createDataFrame([(1, r) for r in [-0.2, -0.1] + [0.01] * 18], "run_id int, ret double")
    r = mt.historical_var(df, {"v95": 0.95, "v99": 0.99}).first()
    assert (r.v95, r.v99) == (0.1, 0.2)


def test_trailing_statements_and_asof(spark, small_chunks):
    q = [("S", f, r, "quarterly", float(v)) for r, f, v in [
        ("2023-12-31", "2024-02-15", 10), ("2024-03-31", "2024-05-15", 11), ("2024-06-30", "2024-08-15", 12), ("2024-09-30", "2024-11-15", 13), ("2024-12-31", "2025-02-15", 14)]]
    s = spark.createDataFrame(q, "symbol string, f string, r string, period string, revenue double").select(
        "symbol", F.to_date("f").alias("filing_date"), F.to_date("r").alias("report_date"), "period", "revenue", F.lit(1.0).alias("total_assets"))
    b = spark.createDataFrame([("S", d) for d in ("2025-02-14", "2025-02-16", "2025-09-01")], "symbol string, d string").withColumn("ts", F.col("d").cast("timestamp"))
    got = {r.d: (r.fund_ttm_revenue, r.fund_stale) for r in fu.attach_fundamentals(b, fu.known_statements(s, ["revenue"], ["total_assets"])).collect()}
    assert got == {"2025-02-14": (46.0, False), "2025-02-16": (50.0, False), "2025-09-01": (None, True)}


def test_vendor_pick_and_restatement(spark):
    rows = spark.createDataFrame([("AAPL", 1, "polygon", 105.0), ("AAPL", 1, "iex", 106.0), ("MSFT", 1, "iex", 205.0)], "symbol string, ts int, vendor string, close double")
    got = {r.symbol: (r.vendor, r.method, r.primary_vendor, r.fallback_vendor) for r in rc.pick_vendor(rows, ["polygon", "iex"]).collect()}
    assert got == {"AAPL": ("polygon", "primary", "polygon", None), "MSFT": ("iex", "fallback", "polygon", "iex")}
    f = spark.createDataFrame([("A", "d", "1", "A1", 100.0), ("A", "d", "2", "A2", 105.0)], "symbol string, report_date string, filing_date string, filing_id string, net_income double")
    r = rc.latest_filings(f, ["symbol", "report_date"]).first()
    assert (r.filing_id, r.net_income, r.method, r.superseded) == ("A2", 105.0, "restatement", 1)


def test_missing_sessions(spark):
    b = spark.createDataFrame([("AAA", d) for d in ("2025-01-02", "2025-01-03", "2025-01-06")] + [("BBB", d) for d in ("2025-01-02", "2025-01-06")], "symbol string, d string").select("symbol", F.col("d").cast("timestamp").alias("ts"))
    gaps = missing_ranges(b, union_calendar(b, DAY)).collect()
    assert [(r.symbol, str(r.start)[:10], r.days) for r in gaps] == [("BBB", "2025-01-03", 1)]
    assert {r.symbol: r.missing_count for r in health.coverage(b).collect()} == {"AAA": 0, "BBB": 1}
    assert {r.missing_count for r in health.coverage(b, "intersection").collect()} == {0}


def test_regime_windows_in_chunks(spark, small_chunks):
    labels = ["low_vol"] * 3 + ["high_vol"] * 9 + ["mid_vol"] + ["high_vol"] * 2
    df = spark.createDataFrame([(i, lab) for i, lab in enumerate(labels)], "i int, label string").select(F.date_add(F.lit("2024-01-01").cast("date"), F.col("i")).alias("ts"), "label", (F.col("i") + 1).cast("bigint").alias("_rn"))
    got = st.find_windows(df, "crash", 2).orderBy(F.desc("days")).collect()
    assert [(str(r.start), str(r.end), r.days) for r in got] == [("2024-01-04", "2024-01-12", 9), ("2024-01-14", "2024-01-15", 2)]


def test_regime_label_quantiles(spark):
    df = spark.createDataFrame([(1, v) for v in (0.1, 0.2, 0.3, 0.5, 0.7, 0.9)], "run_id int, vol double")
    out = rg.label_v1(df, ["run_id"], "vol")
    r = out.first()
    assert (round(r.q33, 6), round(r.q66, 6)) == (0.265, 0.56)
    assert {x.vol: x.label for x in out.collect()} == {0.1: "low_vol", 0.2: "low_vol", 0.3: "mid_vol", 0.5: "mid_vol", 0.7: "high_vol", 0.9: "high_vol"}


def test_gates(spark):
    pairs = spark.createDataFrame([(2, 1)], "candidate bigint, baseline bigint")
    m = spark.createDataFrame([(1, "performance.sharpe", 1.0), (2, "performance.sharpe", 0.9), (1, "performance.max_drawdown", 0.2), (2, "performance.max_drawdown", 0.21),
                               (1, "trading.turnover_1d_mean", 0.1), (2, "trading.turnover_1d_mean", 0.2), (1, "safety.nan_inf_violations", 0.0)], "run_id bigint, metric_id string, value double")
    c = gv.compare(m, pairs)
    got = {r.gate_id: r.status for r in gv.regression_gates(c, pairs).collect()}
    assert got == {"sharpe_guard": "fail", "drawdown_guard": "pass", "turnover_guard": "warn", "nan_inf_guard": "fail"}
    r = gv.gate_report(gv.regression_gates(c, pairs)).first()
    assert (r.overall_status, r.hard_failures, r.soft_warnings) == ("fail", 2, 1)


def test_conflicting_records_fail(spark):
    df = spark.createDataFrame([("A", 1), ("A", 1)], "k string, v int")
    assert sinks.reject_conflicts(df, ["k"]).count() == 1
    with pytest.raises(Exception, match="conflicting record for A"):
        sinks.reject_conflicts(df.union(spark.createDataFrame([("A", 2)], "k string, v int")), ["k"]).collect()


def test_vendor_before_filing(spark):
    f = spark.createDataFrame([("A", "v0", "2020-04-15", "1"), ("A", "v1", "2020-05-20", "2"), ("B", "v1", "2020-05-01", "3"), ("B", "v1", "2020-05-09", None), ("B", "v2", "2020-06-01", "4")],
                              "symbol string, vendor string, filing_date string, filing_id string")
    got = {r.symbol: (r.vendor, r.filing_id, r.method, r.superseded) for r in rc.latest_filings(f, ["symbol"], ["v0", "v1", "v2"]).collect()}
    assert got == {"A": ("v0", "1", "record_vendor", 0), "B": ("v1", None, "restatement", 1)}
    kept = rc.pick_vendor_rows(f, ["v0", "v1", "v2"], ["symbol"]).collect()
    assert sorted((r.symbol, r.vendor) for r in kept) == [("A", "v0"), ("B", "v1"), ("B", "v1")]
    c = rc.vendor_coverage(f, ["v0", "v1", "v2"], ["symbol"]).first()
    assert (c["keys"], c.missing_primary, c.records, c.fallback_records, c.percent_missing_primary) == (2, 1, 3, 2, 0.5)


def test_filter_names_cover_both_label_sets(spark):
    from tapewell.operators import stress as st

    labels = ["high_vol", "low_vol", "mid_vol", "high_vol_trend_up", "high_vol_trend_down", "high_vol_flat", "low_vol_trend_up", "low_vol_trend_down", "low_vol_flat"]
    rows = spark.createDataFrame([(f"2024-01-{k + 1:02d}", k + 1, v) for k, v in enumerate(labels)], "d string, _rn long, label string").withColumn("ts", F.to_timestamp("d"))
    days = {name: sum(r.days for r in st.find_windows(rows, name, 1).collect()) for name in ("crash", "High_Vol ", "low_vol", "mid_vol", "trending", "trend_up", "trend_down", "low_vol_flat")}
    assert days == {"crash": 2, "High_Vol ": 4, "low_vol": 4, "mid_vol": 1, "trending": 2, "trend_up": 2, "trend_down": 2, "low_vol_flat": 1}


def test_new_columns_outlive_upserts(spark, tmp_path):
    from tapewell.sources import sinks

    path = str(tmp_path / "t")
    rows = lambda year, **more: spark.createDataFrame([{"k": 1, "year": year, "v": 1.0, **more}])
    for df in (rows(1997), rows(1998), spark.createDataFrame([{"k": 2, "year": 1998, "v": 2.0, "note": "n"}]), spark.createDataFrame([{"k": 3, "year": 1998, "v": 3.0}])):
        sinks.upsert_partitioned(df, path, ["k", "year"], ["year"], ["k"])
    got = {(r.k, r.year): r.note for r in sinks.read_if_exists(spark, path).collect()}
    assert got == {(1, 1997): None, (1, 1998): None, (2, 1998): "n", (3, 1998): None}
