"""Queries: bars, per-symbol features, labels, calendars, cross-section, regime, backtest."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapewell.operators import backtest, calendars, features as ft
from tapewell.operators.keyed import RN, ordinal, quantiles, rolling, running, time_bucket
from tapewell.plans.catalog import cte, query
from tapewell.session import scratch_path
from tapewell.sources import readers, sinks
from tapewell.sources.tables import DAY, HOUR, Tables

cte("bars_h", """
SELECT event_type AS symbol, date_trunc('hour', ts) AS ts,
  first(value ORDER BY ts, event_id) AS open, max(value) AS high, min(value) AS low,
  last(value ORDER BY ts, event_id) AS close, CAST(count(*) AS DOUBLE) AS volume
FROM events GROUP BY 1, 2
""")
cte("bars_d", """
SELECT p_brand AS symbol, l_shipdate AS ts,
  first(price ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS open, max(price) AS high, min(price) AS low,
  last(price ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS close, sum(l_quantity) AS volume
FROM (SELECT *, l_extendedprice / l_quantity AS price FROM lineitem) JOIN part ON l_partkey = p_partkey GROUP BY 1, 2
""")
cte("vendor_bars", """
SELECT p_brand AS symbol, l_shipdate AS ts, 'v' || CAST(l_suppkey % 3 AS VARCHAR) AS vendor,
  first(price ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS open, max(price) AS high, min(price) AS low,
  last(price ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS close, sum(l_quantity) AS volume
FROM (SELECT *, l_extendedprice / l_quantity AS price FROM lineitem) JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3
""")


def bars_h(t: Tables):
    return ft.numbered_bars(t.bars_h(), HOUR)


def bars_d(t: Tables):
    return ft.numbered_bars(t.bars_d(), DAY)


# This data moves by whole multiples, so the backtests commit a small share of capital.
SHARE = 0.005
W = "WINDOW w AS (PARTITION BY symbol ORDER BY ts)"


def R(n: int) -> str:
    return f"(PARTITION BY symbol ORDER BY ts ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


@query("r01b_hourly_bars", "symbol ts:t open:f high:f low:f close:f volume:f", "SELECT * FROM bars_h")
def _(t):
    """Trades to hourly OHLCV bars (the batch twin of the streaming bars)."""
    return t.bars_h()


@query("s04_canonical_bars_range", "symbol ts:t close:f8 volume:f", """
SELECT * FROM bars_d WHERE symbol IN ('Brand#1','Brand#2','Brand#3') AND ts BETWEEN TIMESTAMP '1997-01-01' AND TIMESTAMP '1998-12-31'
""")
def _(t):
    """Symbols x date range from the canonical bars, written by symbol and year and read back by folder."""
    path = scratch_path(t.spark, "bars")
    sinks.write_bars(t.bars_d().withColumn("vendor", F.lit("v0")), path)
    return readers.canonical_bars(t.spark, path, ["Brand#1", "Brand#2", "Brand#3"], "1997-01-01", "1998-12-31")


@query("w01_simple_returns", "symbol ts:t ret:f8", f"""
SELECT symbol, ts, coalesce(close / nullif(lag(close) OVER w, 0) - 1, 0) AS ret FROM bars_h {W}
""")
def _(t):
    return rolling(bars_h(t), ["symbol"], lambda f, w: {"ret": F.coalesce(ft.change("close", w), F.lit(0.0))}, back=1)


CORE_SQL = f"""
SELECT symbol, ts, close, coalesce(r1, 0) AS ret_1, coalesce(r5, 0) AS ret_5, coalesce(r21, 0) AS ret_21,
  coalesce(CASE WHEN count(r1) OVER {R(21)} >= 21 THEN stddev_pop(r1) OVER {R(21)} END, 0) AS rv_21,
  coalesce(CASE WHEN count(r1) OVER {R(63)} >= 63 THEN stddev_pop(r1) OVER {R(63)} END, 0) AS rv_63,
  coalesce(CASE WHEN count(close) OVER {R(20)} >= 20 THEN close / nullif(max(close) OVER {R(20)}, 0) - 1 END, 0) AS dist_from_20d_high,
  coalesce(CASE WHEN count(close) OVER {R(20)} >= 20 THEN close / nullif(min(close) OVER {R(20)}, 0) - 1 END, 0) AS dist_from_20d_low,
  coalesce(CASE WHEN count(lv) OVER {R(20)} >= 20 THEN (lv - avg(lv) OVER {R(20)}) / nullif(stddev_pop(lv) OVER {R(20)}, 0) END, 0) AS log_vol_z20
FROM (SELECT symbol, ts, close, ln(volume + 1) AS lv,
  ln(CASE WHEN lag(close, 1) OVER w > 0 AND close > 0 THEN close / lag(close, 1) OVER w END) AS r1,
  ln(CASE WHEN lag(close, 5) OVER w > 0 AND close > 0 THEN close / lag(close, 5) OVER w END) AS r5,
  ln(CASE WHEN lag(close, 21) OVER w > 0 AND close > 0 THEN close / lag(close, 21) OVER w END) AS r21
  FROM bars_h {W})
"""
cte("core_sql", CORE_SQL)


@query("w02_log_returns", "symbol ts:t ret_1:f ret_5:f ret_21:f", "SELECT * FROM core_sql")
def _(t):
    return ft.core_v1(bars_h(t))


@query("w03_realised_volatility", "symbol ts:t rv_21:f rv_63:f", "SELECT * FROM core_sql")
def _(t):
    return ft.core_v1(bars_h(t))


@query("w04_range_distance", "symbol ts:t dist_from_20d_high:f dist_from_20d_low:f", "SELECT * FROM core_sql")
def _(t):
    return ft.core_v1(bars_h(t))


@query("w05_volume_zscore", "symbol ts:t log_vol_z20:f5", "SELECT * FROM core_sql")
def _(t):
    return ft.core_v1(bars_h(t))


cte("sma_sql", f"""
SELECT *, coalesce(lag(sma_signal) OVER w, 0.0) AS position FROM (
  SELECT *, CASE WHEN sma_fast > sma_slow THEN 1.0 ELSE 0.0 END AS sma_signal FROM (
    SELECT symbol, ts, close, coalesce(close / nullif(lag(close) OVER w, 0) - 1, 0) AS ret,
      CASE WHEN count(*) OVER {R(5)} = 5 THEN avg(close) OVER {R(5)} END AS sma_fast,
      CASE WHEN count(*) OVER {R(20)} = 20 THEN avg(close) OVER {R(20)} END AS sma_slow
    FROM bars_h {W})) {W}
""")
cte("curve_sql", """
SELECT *, equity / greatest(1.0, max(equity) OVER (PARTITION BY symbol ORDER BY ts)) - 1 AS drawdown FROM (
  SELECT *, product(1 + strategy_ret) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING) AS equity FROM (
    SELECT *, position * ret * 0.005 AS strategy_ret FROM sma_sql))
""")


@query("w06_sma_crossover", "symbol ts:t sma_fast:f sma_slow:f sma_signal:f position:f", "SELECT * FROM sma_sql")
def _(t):
    return ft.sma_crossover(bars_h(t))


@query("w10_equity_drawdown", "symbol ts:t strategy_ret:f equity:f drawdown:f", "SELECT * FROM curve_sql")
def _(t):
    return backtest.strategy_curve(ft.sma_crossover(bars_h(t)), SHARE)


@query("a35_backtest_summary", "symbol total_return:f annualized_return:f annualized_volatility:f sharpe_geo:f max_drawdown:f number_of_trades:i", """
SELECT symbol, tr AS total_return, power(1 + tr, 252.0 / greatest(n, 1)) - 1 AS annualized_return, vol AS annualized_volatility,
  coalesce((power(1 + tr, 252.0 / greatest(n, 1)) - 1) / nullif(vol, 0), 0) AS sharpe_geo, dd AS max_drawdown, trades AS number_of_trades
FROM (SELECT symbol, last(equity ORDER BY ts) - 1 AS tr, count(*) - 1 AS n,
    coalesce(stddev_pop(CASE WHEN rn > 1 THEN strategy_ret END), 0) * sqrt(252) AS vol, abs(min(drawdown)) AS dd,
    coalesce(sum(CASE WHEN position <> prev THEN 1 ELSE 0 END), 0) AS trades
  FROM (SELECT *, row_number() OVER w AS rn, lag(position) OVER w AS prev FROM curve_sql WINDOW w AS (PARTITION BY symbol ORDER BY ts)) GROUP BY symbol)
""")
def _(t):
    return backtest.backtest_summary(backtest.strategy_curve(ft.sma_crossover(bars_h(t)), SHARE))


cte("panel_cal", "SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS sid FROM (SELECT DISTINCT ts FROM bars_h)")
cte("panel_sql", """
SELECT symbol, ts, close, volume, dense_rank() OVER (ORDER BY ts) AS rn FROM (
  SELECT *, count(close) OVER (PARTITION BY ts) AS n FROM (
    SELECT g.symbol, g.ts, last_value(b.close IGNORE NULLS) OVER f AS close, last_value(b.volume IGNORE NULLS) OVER f AS volume
    FROM (SELECT s.symbol, c.ts FROM (SELECT DISTINCT symbol FROM bars_h) s CROSS JOIN panel_cal c) g
    LEFT JOIN bars_h b ON b.symbol = g.symbol AND b.ts = g.ts
    WINDOW f AS (PARTITION BY g.symbol ORDER BY g.ts ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)))
WHERE n = (SELECT count(DISTINCT symbol) FROM bars_h)
""")


def panel_h(t: Tables):
    return calendars.complete_panel(t.bars_h(), HOUR)


@query("u05_complete_panel", "symbol ts:t close:f volume:f", "SELECT * FROM panel_sql")
def _(t):
    """Union calendar, forward fill of 3, sessions where every symbol is present."""
    return panel_h(t)


cte("xret_sql", f"""
SELECT *, coalesce(CASE WHEN count(ret_1d) OVER {R(10)} >= 2 THEN stddev_pop(ret_1d) OVER {R(10)} END, 0) AS vol_10d FROM (
  SELECT symbol, ts, rn, close, volume, ln(volume + 1) AS log_volume,
    coalesce(close / nullif(lag(close, 1) OVER w, 0) - 1, 0) AS ret_1d,
    coalesce(close / nullif(lag(close, 5) OVER w, 0) - 1, 0) AS ret_5d,
    coalesce(close / nullif(lag(close, 20) OVER w, 0) - 1, 0) AS ret_20d,
    coalesce((close - avg(close) OVER {R(20)}) / nullif(avg(close) OVER {R(20)}, 0), 0) AS sma_20_dist
  FROM panel_sql {W})
""")


@query("w07_xsec_base", "symbol ts:t ret_1d:f ret_5d:f ret_20d:f4 vol_10d:f sma_20_dist:f trend_strength_20d:f4", """
SELECT *, coalesce(ret_20d / (vol_10d + 1e-9), 0) AS trend_strength_20d FROM xret_sql
""")
def _(t):
    return ft.panel_returns(panel_h(t))


def z_sql(c: str) -> str:
    return f"CASE WHEN stddev_pop({c}) OVER x > 0 THEN ({c} - avg({c}) OVER x) / (stddev_pop({c}) OVER x + 1e-9) ELSE 0 END"


def rank_sql(c: str) -> str:
    return f"CAST(row_number() OVER (PARTITION BY ts ORDER BY {c}, symbol) - 1 AS DOUBLE) / (count(*) OVER x - 1)"


cte("xsec_sql", f"""
SELECT symbol, ts, rn, close, ret_1d, ret_5d, vol_10d, sma_20_dist, {z_sql('ret_1d')} AS ret_1d_z, {z_sql('ret_5d')} AS ret_5d_z,
  {z_sql('vol_10d')} AS vol_10d_z, {z_sql('log_volume')} AS volume_zscore_20d, ret_20d - avg(ret_20d) OVER x AS rel_strength_20d,
  {rank_sql('ret_1d')} AS ret_1d_rank, {rank_sql('ret_5d')} AS ret_5d_rank, {rank_sql('log_volume')} AS liquidity_rank,
  ret_20d / (vol_10d + 1e-9) AS trend_strength_20d
FROM xret_sql WINDOW x AS (PARTITION BY ts)
""")


@query("w08_xsec_zscore", "symbol ts:t ret_1d_z:f5 ret_5d_z:f5 vol_10d_z:f4 volume_zscore_20d:f5 rel_strength_20d:f4", "SELECT * FROM xsec_sql")
def _(t):
    return ft.cross_section(ft.panel_returns(panel_h(t)))


@query("w09_xsec_rank", "symbol ts:t ret_1d_rank:f ret_5d_rank:f liquidity_rank:f", "SELECT * FROM xsec_sql")
def _(t):
    return ft.cross_section(ft.panel_returns(panel_h(t)))


cte("market_ts_sql", """
SELECT ts, rn, avg(ret_1d) AS market_ret_1d, stddev_pop(ret_1d) AS dispersion_1d, stddev_pop(ret_5d) AS dispersion_5d,
  avg(CAST(ret_1d > 0 AS DOUBLE)) AS breadth_up_1d, avg(CAST(ret_1d < 0 AS DOUBLE)) AS breadth_down_1d, avg(CAST(ret_5d > 0 AS DOUBLE)) AS breadth_up_5d
FROM xret_sql GROUP BY ts, rn
""")
cte("corr_sql", """
SELECT rn, coalesce(avg(c) FILTER (WHERE isfinite(c)), 0) AS corr_mean_20d FROM (
  SELECT t.rn, a.symbol AS s1, b.symbol AS s2, CASE WHEN count(*) >= 2 THEN corr(a.ret_1d, b.ret_1d) END AS c
  FROM (SELECT DISTINCT rn FROM xret_sql) t JOIN xret_sql a ON a.rn BETWEEN t.rn - 19 AND t.rn
  JOIN xret_sql b ON a.rn = b.rn AND a.symbol < b.symbol GROUP BY 1, 2, 3) GROUP BY rn
""")
cte("market_sql", """
SELECT *, coalesce(CASE WHEN count(vol) OVER r20 >= 2 THEN stddev_pop(vol) OVER r20 END, 0) AS market_vol_of_vol_20d, coalesce(vol, 0) AS market_vol_20d FROM (
  SELECT m.*, corr_mean_20d, CASE WHEN count(*) OVER r20 >= 2 THEN stddev_pop(market_ret_1d) OVER r20 END AS vol,
    avg(market_ret_1d) OVER r20 AS market_trend_20d, avg(dispersion_1d) OVER r20 AS dispersion_20d,
    coalesce(corr_mean_20d - CASE WHEN count(*) OVER r60 >= 20 THEN quantile_cont(corr_mean_20d, 0.5) OVER r60 END, 0) AS corr_spike_20d
  FROM market_ts_sql m JOIN corr_sql USING (rn)
  WINDOW r20 AS (ORDER BY rn ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), r60 AS (ORDER BY rn ROWS BETWEEN 59 PRECEDING AND CURRENT ROW))
WINDOW r20 AS (ORDER BY rn ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)
""")


def market(t: Tables):
    return ft.market_features(ft.panel_returns(panel_h(t)))


@query("a06_market_breadth", "ts:t market_ret_1d:f dispersion_1d:f dispersion_5d:f breadth_up_1d:f breadth_down_1d:f breadth_up_5d:f", "SELECT * FROM market_ts_sql")
def _(t):
    return market(t)


@query("w11_market_volatility", "ts:t market_vol_20d:f market_vol_of_vol_20d:f market_trend_20d:f dispersion_20d:f", "SELECT * FROM market_sql")
def _(t):
    return market(t)


@query("w13_pair_correlation", "ts:t corr_mean_20d:f", "SELECT * FROM market_sql")
def _(t):
    return market(t)


@query("j14_pairwise_mean_correlation", "ts:t corr_mean_20d:f", "SELECT * FROM market_sql")
def _(t):
    """Mean over all symbol pairs, from vector sums rather than a self-join."""
    return ft.regime_v1(panel_h(t))


@query("w14_correlation_spike", "ts:t corr_spike_20d:f", "SELECT * FROM market_sql")
def _(t):
    return market(t)


@query("w18_forward_fill", "symbol ts:t close:f filled:b", """
SELECT * FROM (SELECT g.symbol, g.ts, b.close IS NULL AS filled, last_value(b.close IGNORE NULLS) OVER (PARTITION BY g.symbol ORDER BY g.ts ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS close
  FROM (SELECT s.symbol, c.ts FROM (SELECT DISTINCT symbol FROM bars_h) s CROSS JOIN panel_cal c) g LEFT JOIN bars_h b ON b.symbol = g.symbol AND b.ts = g.ts)
WHERE close IS NOT NULL
""")
def _(t):
    bars = t.bars_h()
    return calendars.forward_filled(bars, calendars.union_calendar(bars, HOUR), 3)


@query("w18b_two_way_fill", "symbol ts:t close:f", """
SELECT symbol, ts, coalesce(ff, first_value(ff IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)) AS close
FROM (SELECT symbol, ts, last_value(v IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS ff
  FROM (SELECT symbol, ts, CASE WHEN volume >= 4 THEN close END AS v FROM bars_h))
""")
def _(t):
    """Closes of thin bars blanked, then filled 3 rows forward and 2 rows back."""
    b = bars_h(t).withColumn("close", F.when(F.col("volume") >= 4, F.col("close")))
    return calendars.fill_limits(b, ["symbol"], ["close"], forward=3, backward=2)


@query("j09_calendar_reindex", "symbol ts:t close:f volume:f", """
SELECT g.symbol, g.ts, b.close, b.volume FROM (
  SELECT s.symbol, c.ts FROM (SELECT symbol, min(ts) AS first_ts FROM bars_h GROUP BY 1) s JOIN panel_cal c ON c.ts >= s.first_ts) g
LEFT JOIN bars_h b ON b.symbol = g.symbol AND b.ts = g.ts
""")
def _(t):
    bars = t.bars_h()
    return calendars.dense_grid(bars, calendars.union_calendar(bars, HOUR), ["close", "volume"])


@query("u03_union_calendar", "ts:t sid:i", "SELECT * FROM panel_cal")
def _(t):
    return calendars.union_calendar(t.bars_h(), HOUR)


@query("u04_intersection_calendar", "ts:t", "SELECT ts FROM bars_h GROUP BY ts HAVING count(DISTINCT symbol) = (SELECT count(DISTINCT symbol) FROM bars_h)")
def _(t):
    return calendars.intersection_calendar(t.bars_h())


LABELS_SQL = f"""
SELECT symbol, ts, coalesce(lead(close, 1) OVER w / nullif(close, 0) - 1, 0) AS label_fwd_return_1,
  coalesce(lead(close, 5) OVER w / nullif(close, 0) - 1, 0) AS label_fwd_return_5, coalesce(lead(close, 20) OVER w / nullif(close, 0) - 1, 0) AS label_fwd_return_20,
  least(0, coalesce(min(close) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) / nullif(close, 0) - 1, 0)) AS label_fwd_drawdown_5,
  least(0, coalesce(min(close) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND 20 FOLLOWING) / nullif(close, 0) - 1, 0)) AS label_fwd_drawdown_20
FROM bars_h {W}
"""
cte("labels_sql", LABELS_SQL)


@query("w19_forward_returns", "symbol ts:t label_fwd_return_1:f label_fwd_return_5:f label_fwd_return_20:f", "SELECT * FROM labels_sql")
def _(t):
    return ft.forward_labels(bars_h(t))


@query("w20_forward_drawdown", "symbol ts:t label_fwd_drawdown_5:f label_fwd_drawdown_20:f", "SELECT * FROM labels_sql")
def _(t):
    return ft.forward_labels(bars_h(t))


cte("vol_label_sql", """
SELECT m.ts, m.rn, CASE WHEN market_vol_20d <= q.q33 THEN 'low_vol' WHEN market_vol_20d <= q.q66 THEN 'mid_vol' ELSE 'high_vol' END AS label
FROM market_sql m, (SELECT quantile_cont(market_vol_20d, 0.33) AS q33, quantile_cont(market_vol_20d, 0.66) AS q66 FROM market_sql) q
""")


def vol_labels(t: Tables):
    from tapewell.operators.regimes import label_v1

    return label_v1(market(t), [], "market_vol_20d")


@query("w12_regime_label", "ts:t label:s", "SELECT * FROM vol_label_sql")
def _(t):
    return vol_labels(t)


@query("w21_regime_transition", "ts:t label:s label_regime_transition_1:i label_regime_transition_5:i", """
SELECT ts, label, coalesce(CAST(lead(label) OVER (ORDER BY rn) <> label AS INT), 0) AS label_regime_transition_1,
  coalesce(CAST(lead(label, 5) OVER (ORDER BY rn) <> label AS INT), 0) AS label_regime_transition_5 FROM vol_label_sql
""")
def _(t):
    return ft.transition_flags(vol_labels(t), [], "label", (1, 5))


@query("a33_equal_weight", "ts:t ret:f equity:f drawdown:f misaligned:i", """
SELECT *, equity / greatest(1.0, max(equity) OVER (ORDER BY ts)) - 1 AS drawdown FROM (
  SELECT *, product(1 + ret) OVER (ORDER BY ts) AS equity FROM (
    SELECT ts, avg(position * ret * 0.005) AS ret, 5 - count(*) AS misaligned FROM (
      SELECT symbol, ts, ret, coalesce(lag(CASE WHEN f5 > s20 THEN 1.0 ELSE 0.0 END) OVER w, 0) AS position FROM (
        SELECT symbol, ts, coalesce(close / lag(close) OVER w - 1, 0) AS ret,
          CASE WHEN count(*) OVER (PARTITION BY symbol ORDER BY ts ROWS 4 PRECEDING) = 5 THEN avg(close) OVER (PARTITION BY symbol ORDER BY ts ROWS 4 PRECEDING) END AS f5,
          CASE WHEN count(*) OVER (PARTITION BY symbol ORDER BY ts ROWS 19 PRECEDING) = 20 THEN avg(close) OVER (PARTITION BY symbol ORDER BY ts ROWS 19 PRECEDING) END AS s20
        FROM panel_sql WINDOW w AS (PARTITION BY symbol ORDER BY ts)) WINDOW w AS (PARTITION BY symbol ORDER BY ts))
    GROUP BY ts))
""")
def _(t):
    return backtest.equal_weight(backtest.strategy_curve(ft.sma_crossover(panel_h(t)), SHARE))


@query("w30_previous_session", "symbol ts:t prev:t", f"SELECT symbol, ts, lag(ts) OVER w AS prev FROM bars_d {W}")
def _(t):
    return rolling(bars_d(t), ["symbol"], lambda f, w: {"prev": F.lag("ts").over(w)}, back=1)


@query("w31_report_overlay", "symbol ts:t close:f ma20:f is_max:b is_min:b", f"""
SELECT symbol, ts, close, avg(close) OVER {R(20)} AS ma20,
  ts = (first_value(ts) OVER (PARTITION BY symbol ORDER BY close DESC, ts)) AS is_max, ts = (first_value(ts) OVER (PARTITION BY symbol ORDER BY close, ts)) AS is_min
FROM bars_h
""")
def _(t):
    """A 20-row average with the highest and the lowest point of each series marked."""
    b = bars_h(t)
    marks = b.groupBy("symbol").agg(
        F.max_by(RN, F.struct("close", -F.col(RN))).alias("_hi"), F.min_by(RN, F.struct("close", RN)).alias("_lo"),
    )
    out = rolling(b, ["symbol"], lambda f, w: {"ma20": F.avg("close").over(f(-19, 0))}, back=19)
    return out.join(marks, "symbol").withColumn("is_max", F.col(RN) == F.col("_hi")).withColumn("is_min", F.col(RN) == F.col("_lo"))
