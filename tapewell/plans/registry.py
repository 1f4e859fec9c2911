"""Feature-set register and column contracts."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame


def merge_columns(primary: Sequence[str], secondary: Sequence[str]) -> list[str]:
    """Columns of both lists in order, each once."""
    return list(dict.fromkeys([*primary, *secondary]))


def ordered_columns(df: DataFrame, observations: Sequence[str], extra: Sequence[str] = ()) -> DataFrame:
    """ts, the observation columns in contract order, then ``extra``; missing columns are an error."""
    want = merge_columns(["ts", *observations], extra)
    missing = [c for c in want if c not in df.columns]
    if missing:
        raise ValueError(f"columns missing from the feature set: {missing}")
    return df.select(*[f"`{c}`" for c in want])


@dataclass(frozen=True)
class FeatureSet:
    name: str
    builder: Callable[..., DataFrame]
    columns: tuple[str, ...]
    universe: bool = False


FEATURE_SETS: dict[str, FeatureSet] = {}


def register_feature_set(name: str, builder: Callable[..., DataFrame], columns: Sequence[str], *, universe: bool = False) -> None:
    if name in FEATURE_SETS:
        raise ValueError(f"feature set {name} exists")
    FEATURE_SETS[name] = FeatureSet(name, builder, tuple(columns), universe)


# -- named feature sets ----------------------------------------------------------------------


@dataclass(frozen=True)
class Inputs:
    """What a builder may draw on; ``bars`` has symbol, ts, close, volume, one row per session."""

    bars: DataFrame
    step_seconds: int
    statements: DataFrame | None = None
    trades: DataFrame | None = None
    options: DataFrame | None = None
    surface: DataFrame | None = None
    regime_universe: tuple[str, ...] | None = None


def _register_all() -> None:
    from pyspark.sql import functions as F

    from tapewell.operators import features as ft
    from tapewell.operators import fundamentals as fu
    from tapewell.operators import insiders as ins
    from tapewell.operators import options as op
    from tapewell.operators.calendars import complete_panel
    from tapewell.session import checkpointed

    fund = ("fund_ttm_revenue", "fund_ttm_net_income", "fund_total_assets", "fund_row_valid", "fund_stale")
    surf = (*op.SURFACE_FEATURES, *op.FLAGS)
    sma = ("close", *ft.SMA_COLUMNS)

    def placed(i: Inputs) -> DataFrame:
        return ft.numbered_bars(i.bars, i.step_seconds)

    def core(i: Inputs) -> DataFrame:
        return ft.core_v1(placed(i))

    def sma_set(i: Inputs) -> DataFrame:
        return ft.sma_v1(placed(i))

    def by_day(i: Inputs) -> DataFrame:
        return i.bars.withColumn("date", F.col("ts").cast("date"))

    def options_set(i: Inputs) -> DataFrame:
        return op.options_v1(by_day(i), i.options)

    def surface_set(i: Inputs, lagged: bool = False) -> DataFrame:
        bars = op.previous_session(by_day(i))
        merged = op.attach_surface(bars, i.surface, "prev_date" if lagged else "date")
        return op.surface_features(merged)

    def fundamentals(i: Inputs) -> DataFrame:
        known = fu.known_statements(i.statements, ("revenue", "net_income"), ("total_assets",))
        out = fu.attach_fundamentals(i.bars, known, "ts", i.step_seconds)
        return out.select("symbol", "ts", *fund)

    def panel(i: Inputs) -> DataFrame:
        return complete_panel(i.bars, i.step_seconds)

    def regime(i: Inputs) -> DataFrame:
        return ft.regime_v1(panel(i), i.regime_universe).drop("_rn")

    def join(left: DataFrame, right: DataFrame, columns: Sequence[str]) -> DataFrame:
        """Inner join on (symbol, ts); columns the left side has are not taken twice."""
        extra = [c for c in columns if c not in left.columns]
        return left.join(right.select("symbol", "ts", *[f"`{c}`" for c in extra]), ["symbol", "ts"])

    def combo(*parts: str, lagged: bool = False, base=core) -> Callable[[Inputs], DataFrame]:
        def build(i: Inputs) -> DataFrame:
            out = base(i)
            if "fund" in parts:
                out = join(out, fundamentals(i), fund)
            if "xsec" in parts or "regime" in parts:
                shared = panel(i)
            if "xsec" in parts:
                out = join(out, ft.equity_xsec_v1(shared).drop("close"), ft.XSEC_COLUMNS)
            if "options" in parts:
                out = join(out, options_set(i), op.OPTION_COLUMNS)
            if "surface" in parts:
                out = join(out, surface_set(i, lagged), surf)
            if "regime" in parts:
                market = ft.regime_v1(shared, i.regime_universe).drop("_rn")
                taken = [c for c in market.columns if c == "ts" or c not in out.columns]
                out = out.join(market.select(*taken), "ts")
            return out

        return build

    core_cols, xsec, reg = ft.CORE_COLUMNS, ft.XSEC_COLUMNS, ft.REGIME_COLUMNS

    def cols(*groups: Sequence[str]) -> list[str]:
        return merge_columns([], [c for g in groups for c in g])

    add = register_feature_set
    add("sma_v1", sma_set, sma)
    add("sma_universe_v1", sma_set, sma)
    add("options_v1", options_set, op.OPTION_COLUMNS)
    add("sma_plus_options_v1", combo("options", base=sma_set), cols(sma, op.OPTION_COLUMNS))
    add("core_v1", core, core_cols)
    add("core_v1_fundamentals_v1", combo("fund"), cols(core_cols, fund))
    add("insiders_v1", lambda i: ins.insiders_v1(placed(i).withColumn("day", F.col("ts").cast("date")), i.trades), ins.INSIDER_COLUMNS)
    add("options_surface_v1", surface_set, surf)
    add("options_surface_v1_lag1", lambda i: surface_set(i, True), surf)
    add("equity_xsec_v1", lambda i: ft.equity_xsec_v1(panel(i)), xsec, universe=True)
    add("sma_plus_xsec_v1", combo("xsec", base=sma_set), cols(sma, xsec), universe=True)
    add("core_v1_xsec", combo("xsec"), cols(core_cols, xsec), universe=True)
    add("core_v1_regime", combo("regime"), cols(core_cols, reg), universe=True)
    add("core_v1_xsec_regime", combo("xsec", "regime"), cols(core_cols, xsec, reg), universe=True)
    add("core_v1_xsec_regime_opts_v1", combo("xsec", "regime", "surface"), cols(core_cols, xsec, surf, reg), universe=True)
    add("core_v1_xsec_regime_opts_v1_lag1", combo("xsec", "regime", "surface", lagged=True), cols(core_cols, xsec, surf, reg), universe=True)
    add("core_v1_fundamentals_regime_v1", combo("fund", "regime"), cols(core_cols, fund, reg), universe=True)
    add("core_v1_fundamentals_regime_xsec_v1", combo("fund", "xsec", "regime"), cols(core_cols, fund, xsec, reg), universe=True)
    add("core_v1_fundamentals_regime_opts_v1", combo("fund", "surface", "regime"), cols(core_cols, fund, surf, reg), universe=True)
    add("regime_v1", regime, reg, universe=True)
    add("regime_v1_1", regime, reg, universe=True)


def build(name: str, inputs: Inputs) -> DataFrame:
    """A feature set as (symbol, ts, contract columns); market-level sets have no symbol."""
    if not FEATURE_SETS:
        _register_all()
    fs = FEATURE_SETS[name]
    out = fs.builder(inputs)
    keys = [c for c in ("symbol",) if c in out.columns]
    return ordered_columns(out, fs.columns, keys)


def universe_panel(features: DataFrame, step_seconds: int, columns: Sequence[str], regime: DataFrame | None = None) -> DataFrame:
    """Feature rows on a shared calendar: filled 3 sessions, complete sessions only, the rest 0."""
    from tapewell.operators.calendars import complete_panel

    out = complete_panel(features.select("symbol", "ts", *merge_columns(["close"], columns)), step_seconds, gappy=list(columns))
    out = out.fillna(0.0, list(columns))
    return out.join(regime, "ts") if regime is not None else out


def nested_panel(panel: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per session with a map symbol -> features (as wide as the universe)."""
    from pyspark.sql import functions as F

    entry = F.struct("symbol", F.struct(*columns).alias("features"))
    return panel.groupBy("ts").agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("panel"))
