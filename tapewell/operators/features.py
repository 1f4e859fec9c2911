"""Per-symbol, cross-sectional and market-level features and forward labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapewell.operators.keyed import RN, ordinal, rolling, time_bucket

EPS = 1e-9

CORE_COLUMNS = (
    "ret_1", "ret_5", "ret_21", "rv_21", "rv_63",
    "dist_from_20d_high", "dist_from_20d_low", "log_vol_z20",
)
SMA_COLUMNS = ("sma_fast", "sma_slow", "sma_diff", "sma_signal")
XSEC_COLUMNS = (
    "ret_1d", "ret_5d", "vol_10d", "sma_20_dist", "ret_1d_z", "ret_5d_z", "vol_10d_z",
    "ret_1d_rank", "ret_5d_rank", "rel_strength_20d", "volume_zscore_20d", "liquidity_rank",
    "trend_strength_20d", "market_ret_1d", "market_vol_20d", "market_vol_of_vol_20d",
    "dispersion_1d", "dispersion_5d", "breadth_up_1d", "breadth_down_1d", "breadth_up_5d",
    "corr_mean_20d", "corr_spike_20d",
)
REGIME_COLUMNS = ("market_vol_20d", "market_trend_20d", "dispersion_20d", "corr_mean_20d")


def numbered_bars(bars: DataFrame, step_seconds: int) -> DataFrame:
    """Bars with ``_rn``, their position within the symbol."""
    return ordinal(bars, ["symbol"], ["ts"], time_bucket("ts", step_seconds))


def full(agg: Column, col: str, window, n: int) -> Column:
    """``agg`` over a window only where ``n`` non-null rows are present."""
    return F.when(F.count(col).over(window) >= n, agg.over(window))


def change(col: str, w, n: int = 1) -> Column:
    """Percent change over ``n`` rows; null where the base is absent or zero."""
    prev = F.lag(col, n).over(w)
    return F.try_divide(F.col(col), prev) - 1.0


def core_v1(bars: DataFrame) -> DataFrame:
    """Log returns, realised volatility, distance from the 20-row range and volume z-score."""

    def returns(f, w):
        out = {f"ret_{n}": F.ln(F.try_divide(F.col("close"), F.lag("close", n).over(w))) for n in (1, 5, 21)}
        out["_lv"] = F.log1p("volume")
        return out

    def rest(f, w):
        r20 = f(-19, 0)
        sd = F.nullif(full(F.stddev_pop("_lv"), "_lv", r20, 20), F.lit(0.0))
        return {
            "rv_21": full(F.stddev_pop("ret_1"), "ret_1", f(-20, 0), 21),
            "rv_63": full(F.stddev_pop("ret_1"), "ret_1", f(-62, 0), 63),
            "dist_from_20d_high": F.try_divide(F.col("close"), full(F.max("close"), "close", r20, 20)) - 1.0,
            "dist_from_20d_low": F.try_divide(F.col("close"), full(F.min("close"), "close", r20, 20)) - 1.0,
            "log_vol_z20": F.try_divide(F.col("_lv") - full(F.avg("_lv"), "_lv", r20, 20), sd),
        }

    out = rolling(bars, ["symbol"], returns, rest, back=63).drop("_lv")
    return out.fillna(0.0, subset=list(CORE_COLUMNS))


def sma_crossover(bars: DataFrame, fast: int = 5, slow: int = 20) -> DataFrame:
    """Fast and slow averages (full windows only), the signal, and the position held from the last row."""

    def averages(f, w):
        return {
            "sma_fast": full(F.avg("close"), "close", f(-(fast - 1), 0), fast),
            "sma_slow": full(F.avg("close"), "close", f(-(slow - 1), 0), slow),
        }

    def signal(f, w):
        return {"sma_signal": F.when(F.col("sma_fast") > F.col("sma_slow"), 1.0).otherwise(0.0)}

    def position(f, w):
        return {
            "position": F.coalesce(F.lag("sma_signal").over(w), F.lit(0.0)),
            "ret": F.coalesce(change("close", w), F.lit(0.0)),
        }

    return rolling(bars, ["symbol"], averages, signal, position, back=max(fast, slow) + 1)


def sma_v1(bars: DataFrame, fast: int = 5, slow: int = 20) -> DataFrame:
    """The crossover as features: rows where both averages exist."""
    s = sma_crossover(bars, fast, slow).filter(F.col("sma_fast").isNotNull() & F.col("sma_slow").isNotNull())
    return s.withColumn("sma_diff", F.col("sma_fast") - F.col("sma_slow"))


def forward_labels(
    bars: DataFrame, returns: Sequence[int] = (1, 5, 20), drawdowns: Sequence[int] = (5, 20), price: str = "close",
) -> DataFrame:
    """Forward returns (0 past the end) and the worst forward move within a horizon (at most 0)."""
    p = F.col(price)

    def labels(f, w):
        out = {}
        for h in returns:
            ahead = F.lead(price, h).over(w)
            out[f"label_fwd_return_{h}"] = F.coalesce(F.try_divide(ahead - p, p), F.lit(0.0))
        for h in drawdowns:
            low = F.min(price).over(f(1, h))
            out[f"label_fwd_drawdown_{h}"] = F.least(F.lit(0.0), F.coalesce(F.try_divide(low - p, p), F.lit(0.0)))
        return out

    return rolling(bars, ["symbol"], labels, fwd=max([*returns, *drawdowns]))


def transition_flags(df: DataFrame, keys: Sequence[str], label: str, horizons: Sequence[int] = (1,)) -> DataFrame:
    """1 where the label ``h`` rows ahead exists and differs."""

    def flags(f, w):
        return {
            f"label_regime_transition_{h}": F.coalesce((F.lead(label, h).over(w) != F.col(label)).cast("int"), F.lit(0))
            for h in horizons
        }

    return rolling(df, keys, flags, fwd=max(horizons))


def panel_returns(panel: DataFrame, corr_window: int = 20) -> DataFrame:
    """Per-symbol part of the cross-section: returns, volatility, range, unit-length return vectors."""

    def returns(f, w):
        out = {f"ret_{n}d": F.coalesce(change("close", w, n), F.lit(0.0)) for n in (1, 5, 20)}
        sma = F.avg("close").over(f(-19, 0))
        out["sma_20_dist"] = F.coalesce(F.try_divide(F.col("close") - sma, sma), F.lit(0.0))
        out["log_volume"] = F.log1p("volume")
        return out

    def spread(f, w):
        recent = f(-(corr_window - 1), 0)
        return {
            "vol_10d": F.coalesce(full(F.stddev_pop("ret_1d"), "ret_1d", f(-9, 0), 2), F.lit(0.0)),
            "_win": F.collect_list("ret_1d").over(recent),
            "_mu": F.avg("ret_1d").over(recent),
        }

    def trend(f, w):
        return {"trend_strength_20d": F.coalesce(F.try_divide(F.col("ret_20d"), F.col("vol_10d") + EPS), F.lit(0.0))}

    out = rolling(panel, ["symbol"], returns, spread, trend, back=20 + max(10, corr_window))
    centred = F.transform("_win", lambda x: x - F.col("_mu"))
    norm = F.sqrt(F.aggregate("_c", F.lit(0.0), lambda a, x: a + x * x))
    out = out.withColumn("_c", centred).withColumn("_norm", norm)
    unit = F.when(F.col("_norm") > 0, F.transform("_c", lambda x: x / F.col("_norm")))
    return out.withColumn("_unit", unit).drop("_win", "_mu", "_c", "_norm")


def _pair_correlation(width: int) -> Column:
    """Mean correlation of all symbol pairs from the sums of unit vectors: no pair is formed.

    The squared length of the sum of M unit vectors is M plus twice the sum of their pairwise
    correlations.
    """
    sums = [F.coalesce(F.sum(F.get("_unit", F.lit(k))), F.lit(0.0)) for k in range(width)]
    total = sums[0] * sums[0]
    for s in sums[1:]:
        total = total + s * s
    m = F.count("_unit")
    return F.coalesce(F.try_divide(total - m, m * (m - 1)), F.lit(0.0))


def market_features(returns: DataFrame, corr_window: int = 20) -> DataFrame:
    """One row per session: market return, dispersion, breadth, volatility, correlation and its spike."""

    def share(cond: Column) -> Column:
        return F.avg(cond.cast("double"))

    per_ts = returns.groupBy("ts", RN).agg(
        F.avg("ret_1d").alias("market_ret_1d"),
        F.stddev_pop("ret_1d").alias("dispersion_1d"),
        F.stddev_pop("ret_5d").alias("dispersion_5d"),
        share(F.col("ret_1d") > 0).alias("breadth_up_1d"),
        share(F.col("ret_1d") < 0).alias("breadth_down_1d"),
        share(F.col("ret_5d") > 0).alias("breadth_up_5d"),
        _pair_correlation(corr_window).alias("corr_mean_20d"),
    )

    def first(f, w):
        r20 = f(-19, 0)
        return {
            "_vol": full(F.stddev_pop("market_ret_1d"), "market_ret_1d", r20, 2),
            "market_trend_20d": F.avg("market_ret_1d").over(r20),
            "dispersion_20d": F.avg("dispersion_1d").over(r20),
            "_med": full(F.percentile("corr_mean_20d", F.lit(0.5)), "corr_mean_20d", f(-59, 0), 20),
        }

    def second(f, w):
        return {
            "market_vol_20d": F.coalesce("_vol", F.lit(0.0)),
            "market_vol_of_vol_20d": F.coalesce(full(F.stddev_pop("_vol"), "_vol", f(-19, 0), 2), F.lit(0.0)),
            "corr_spike_20d": F.coalesce(F.col("corr_mean_20d") - F.col("_med"), F.lit(0.0)),
        }

    return rolling(per_ts, [], first, second, back=60).drop("_vol", "_med")


def zscore(col: str, w) -> Column:
    sd = F.stddev_pop(col).over(w)
    return F.when(sd > 0, (F.col(col) - F.avg(col).over(w)) / (sd + EPS)).otherwise(0.0)


def unit_rank(col: str, ts: str = "ts") -> Column:
    """Position in [0, 1] among the symbols of a session, ties by symbol."""
    n = F.count(F.lit(1)).over(Window.partitionBy(ts))
    pos = F.row_number().over(Window.partitionBy(ts).orderBy(col, "symbol")) - 1
    return F.coalesce(F.try_divide(pos.cast("double"), n - 1), F.lit(0.0))


def cross_section(returns: DataFrame) -> DataFrame:
    """Z-scores and ranks among the symbols of a session.

    A panel session holds one row per symbol, so the window is as wide as the universe, no wider.
    """
    w = Window.partitionBy("ts")
    return returns.withColumns({
        "ret_1d_z": zscore("ret_1d", w), "ret_5d_z": zscore("ret_5d", w), "vol_10d_z": zscore("vol_10d", w),
        "volume_zscore_20d": zscore("log_volume", w),
        "rel_strength_20d": F.col("ret_20d") - F.avg("ret_20d").over(w),
        "ret_1d_rank": unit_rank("ret_1d"), "ret_5d_rank": unit_rank("ret_5d"), "liquidity_rank": unit_rank("log_volume"),
    })


def equity_xsec_v1(panel: DataFrame) -> DataFrame:
    """The 23 cross-sectional columns on a complete panel (``calendars.complete_panel``)."""
    returns = panel_returns(panel)
    market = market_features(returns)
    keep = [c for c in XSEC_COLUMNS if c in market.columns]
    joined = cross_section(returns.drop("_unit")).join(market.select("ts", *keep), "ts")
    return joined.select("symbol", "ts", RN, "close", *XSEC_COLUMNS)


def regime_v1(panel: DataFrame, universe: Sequence[str] | None = None) -> DataFrame:
    """Market volatility, trend, dispersion and correlation; ``universe`` fixes the symbols used."""
    chosen = panel.filter(F.col("symbol").isin(list(universe))) if universe else panel
    market = market_features(panel_returns(chosen.drop("volume").withColumn("volume", F.lit(0.0))))
    return market.select("ts", RN, *REGIME_COLUMNS)
