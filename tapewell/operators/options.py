"""Option open interest and volume per underlying and day, and surface features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapewell.functions import scalars as sc
from tapewell.operators.keyed import ordinal, rolling, running, time_bucket
from tapewell.session import checkpointed

EPS = 1e-9
DAY = 86_400
FILL_DAYS = 2

OPTION_COLUMNS = (
    "oi_total", "oi_call_total", "oi_put_total", "oi_put_call_ratio", "oi_concentration_top10", "oi_change_1d", "oi_change_pct_1d",
    "options_volume_total", "options_volume_call_total", "options_volume_put_total",
)


def typed(rows: DataFrame, reference: DataFrame) -> DataFrame:
    """Option type through the reference, else from the contract symbol."""
    ref = reference.select(F.upper("option_symbol").alias("option_symbol"), "underlying", "option_type")
    out = rows.withColumn("option_symbol", F.upper("option_symbol")).join(ref, "option_symbol", "left")
    return out.withColumn("option_type", F.coalesce("option_type", sc.option_type_from_symbol("option_symbol")))


def _side(kind: str, value: str) -> Column:
    return F.sum(F.when(F.col("option_type") == kind, F.col(value)))


def daily_interest(rows: DataFrame) -> DataFrame:
    """Total, call and put interest, ratio, and the share of the ten largest contracts."""
    known = rows.filter(F.col("option_type").isNotNull())
    keys = ["underlying", "date"]
    totals = known.groupBy(*keys).agg(
        F.sum("open_interest").alias("oi_total"), _side("call", "open_interest").alias("oi_call_total"), _side("put", "open_interest").alias("oi_put_total"),
    )
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("open_interest"), "option_symbol"))
    top = known.select(*keys, "option_symbol", "open_interest").withColumn("_r", rank).filter("_r <= 10").groupBy(*keys).agg(F.sum("open_interest").alias("_top"))
    out = totals.join(top, keys)
    share = F.when(F.col("oi_total") > 0, F.col("_top") / F.col("oi_total")).otherwise(0.0)
    ratio = (F.col("oi_put_total") + EPS) / (F.col("oi_call_total") + EPS)
    return out.withColumns({"oi_concentration_top10": share, "oi_put_call_ratio": ratio}).drop("_top")


def daily_volume(rows: DataFrame) -> DataFrame:
    return rows.groupBy("underlying", "date").agg(
        F.sum("volume").alias("options_volume_total"), _side("call", "volume").alias("options_volume_call_total"),
        _side("put", "volume").alias("options_volume_put_total"),
    )


def daily_options(interest: DataFrame, volume: DataFrame) -> DataFrame:
    """Interest and volume days, each kept where the other is absent."""
    return interest.join(volume, ["underlying", "date"], "full")


def options_v1(sessions: DataFrame, daily: DataFrame, fill_days: int = FILL_DAYS) -> DataFrame:
    """Daily option features on the equity sessions ``(symbol, date, ...)``: levels filled for
    ``fill_days`` sessions, changes on the filled levels, absent volume 0."""
    joined = sessions.join(daily.withColumnRenamed("underlying", "symbol"), ["symbol", "date"], "left")
    placed = ordinal(joined, ["symbol"], ["date"], time_bucket("date", DAY))
    levels = ("oi_total", "oi_call_total", "oi_put_total", "oi_concentration_top10")

    def fill(f, w):
        return {c: F.last(c, ignorenulls=True).over(f(-fill_days, 0)) for c in levels}

    def derive(f, w):
        prev = F.lag("oi_total").over(w)
        step = F.col("oi_total") - prev
        return {
            "oi_put_call_ratio": F.coalesce((F.col("oi_put_total") + EPS) / (F.col("oi_call_total") + EPS), F.lit(1.0)),
            "oi_change_1d": F.coalesce(step, F.lit(0.0)),
            "oi_change_pct_1d": F.coalesce(F.try_divide(step, prev + EPS), F.lit(0.0)),
        }

    out = rolling(placed, ["symbol"], fill, derive, back=fill_days + 1)
    return out.fillna(0.0, ["oi_concentration_top10", "options_volume_total", "options_volume_call_total", "options_volume_put_total"])


# -- surfaces --------------------------------------------------------------------------------

TENORS = (30, 60, 90, 120, 150, 180)
HV_DAYS = (10, 20, 30, 60, 90, 120, 150, 180)
OI = tuple(f"OPT:OI:{x}" for x in ("CALL", "PUT", "TOTAL", "CALL_PUT_RATIO"))
VOL = tuple(f"OPT:VOL:{x}" for x in ("CALL", "PUT", "TOTAL", "CALL_PUT_RATIO"))
SLOPES = ("OPT:IVX:TERM_SLOPE_30_90", "OPT:IVX:TERM_SLOPE_30_180")
IVX, IVR, IVP = (tuple(f"OPT:{k}:{n}" for n in TENORS) for k in ("IVX", "IVR", "IVP"))
HV = tuple(f"OPT:HV:{n}" for n in HV_DAYS)
FLAGS = tuple(f"OPT:COVERAGE:{x}" for x in ("HAS_OI", "HAS_OPT_VOLUME", "HAS_IVX", "HAS_IVR", "HAS_IVP", "HAS_HV", "ROW_VALID"))
VALUES = (*OI, *VOL, *IVX, *SLOPES, *IVR, *IVP, *HV)
SURFACE_COLUMNS = (*VALUES, *FLAGS)

# Vendor field names.
ALIASES: dict[str, tuple[str, ...]] = {
    "OPT:OI:CALL": ("call_open_interest", "callOpenInterest", "callOI", "oiCall", "openInterestCall"),
    "OPT:OI:PUT": ("put_open_interest", "putOpenInterest", "putOI", "oiPut", "openInterestPut"),
    "OPT:OI:TOTAL": ("total_open_interest", "totalOpenInterest", "openInterestTotal", "oiTotal"),
    "OPT:VOL:CALL": ("call_volume", "callVolume", "volumeCall", "optVolumeCall", "optVolCall", "OPT_VOL_CALL"),
    "OPT:VOL:PUT": ("put_volume", "putVolume", "volumePut", "optVolumePut", "optVolPut", "OPT_VOL_PUT"),
    "OPT:VOL:TOTAL": ("total_volume", "totalVolume", "volumeTotal", "optVolumeTotal", "optVol", "OPT_VOL"),
    "OPT:VOL:CALL_PUT_RATIO": ("call_put_volume_ratio", "callPutVolumeRatio", "CALL_PUT_VOLUME_RATIO"),
}
SYMBOL_FIELDS = ("symbol", "underlying_symbol", "underlyingSymbol", "ticker", "root")
DATE_FIELDS = ("date", "pricingDate", "as_of", "asOf", "tradeDate", "tradingDate")
VOL_RANGE = (0.0, 5.0)


def _aliases(column: str) -> tuple[str, ...]:
    if column in ALIASES:
        return ALIASES[column]
    _, kind, n = column.split(":")
    return f"{kind.lower()}_{n}", f"{kind.lower()}{n}", f"{kind}{n}"


def q(column: str) -> Column:
    return F.col(f"`{column}`")


def normalize_surface(raw: DataFrame, vol_unit: str = "percent", *, strict_slope: bool = True) -> DataFrame:
    """Vendor surface rows to the fixed ``OPT:*`` columns with coverage flags.

    Negative interest or volume and volatilities outside [0, 5] become null and make the row invalid.
    Term slopes are taken before scaling; ``strict_slope`` puts them under the same range rule.
    """
    cols = raw.columns
    numeric = {n for n, kind in raw.dtypes if kind in ("double", "float", "int", "bigint", "smallint")}  # no text to parse, less code per column
    given = [c for c in VALUES if c not in (*SLOPES, "OPT:OI:CALL_PUT_RATIO")]
    picked = raw.select(
        sc.normalize_symbol(F.coalesce(*[sc.blank_to_null(f"`{c}`") for c in SYMBOL_FIELDS if c in cols])).alias("symbol"),
        F.coalesce(*[sc.blank_to_null(f"`{c}`").try_cast("timestamp") for c in DATE_FIELDS if c in cols]).cast("date").alias("date"),
        *[sc.first_float(cols, _aliases(c), numeric).alias(c) for c in given],
    ).filter(F.col("symbol").isNotNull() & F.col("date").isNotNull())

    counts = ("OPT:OI:CALL", "OPT:OI:PUT", "OPT:OI:TOTAL", "OPT:VOL:CALL", "OPT:VOL:PUT", "OPT:VOL:TOTAL")
    negative = F.lit(False)
    for c in counts:
        negative = negative | F.coalesce(q(c) < 0, F.lit(False))
    out = picked.withColumn("_bad", negative).withColumns({c: F.when(q(c) >= 0, q(c)) for c in counts})

    def total(kind: str) -> Column:
        call, put = q(f"OPT:{kind}:CALL"), q(f"OPT:{kind}:PUT")
        both = F.when(call.isNotNull() | put.isNotNull(), F.coalesce(call, F.lit(0.0)) + F.coalesce(put, F.lit(0.0)))
        return F.coalesce(q(f"OPT:{kind}:TOTAL"), both)

    ratio = lambda kind: sc.safe_ratio(q(f"OPT:{kind}:CALL"), q(f"OPT:{kind}:PUT"))
    out = out.withColumns({
        "OPT:OI:TOTAL": total("OI"), "OPT:VOL:TOTAL": total("VOL"), "OPT:OI:CALL_PUT_RATIO": ratio("OI"),
        "OPT:VOL:CALL_PUT_RATIO": F.coalesce(ratio("VOL"), q("OPT:VOL:CALL_PUT_RATIO")),
        SLOPES[0]: q("OPT:IVX:90") - q("OPT:IVX:30"), SLOPES[1]: q("OPT:IVX:180") - q("OPT:IVX:30"),
    })
    scale = 100.0 if vol_unit == "percent" else 1.0
    ranged = [*IVX, *HV, *(SLOPES if strict_slope else ())]
    scaled = {c: q(c) / scale for c in (*IVX, *HV, *SLOPES)}
    out = out.withColumns(scaled)
    wild = F.col("_bad")
    for c in ranged:
        wild = wild | F.coalesce(~q(c).between(*VOL_RANGE), F.lit(False))
    out = out.withColumn("_bad", wild).withColumns({c: F.when(q(c).between(*VOL_RANGE), q(c)) for c in ranged})

    def any_of(columns) -> Column:
        return F.coalesce(*[q(c) for c in columns]).isNotNull()

    has = dict(zip(FLAGS, map(any_of, (OI[:3], VOL[:3], IVX, IVR, IVP, HV))))
    out = out.withColumns(has)
    some = F.lit(False)
    for flag in FLAGS[:-1]:
        some = some | q(flag)
    return out.withColumn(FLAGS[-1], some & ~F.col("_bad")).select("symbol", "date", *[q(c) for c in SURFACE_COLUMNS])


def attach_surface(bars: DataFrame, surface: DataFrame, on: str = "date") -> DataFrame:
    """Surface of the bar's ``on`` date; without one, values null and flags false."""
    s = surface.withColumnRenamed("date", "_on") if on != "date" else surface.withColumn("_on", F.col("date")).drop("date")
    out = bars.withColumn("_on", F.col(on)).join(s, ["symbol", "_on"], "left").drop("_on")
    return out.withColumns({c: F.coalesce(q(c), F.lit(False)) for c in FLAGS})


def previous_session(bars: DataFrame) -> DataFrame:
    """Bars with ``_rn`` and ``prev_date``, the symbol's session before (one bar per session)."""
    placed = ordinal(bars, ["symbol"], ["date"], time_bucket("date", DAY))
    return rolling(placed, ["symbol"], lambda f, w: {"prev_date": F.lag("date").over(w)}, back=1)


SURFACE_FEATURES = (
    "OPT:OI:TOTAL", "OPT:OI:CALL_PUT_RATIO", "OPT:VOL:TOTAL", "OPT:VOL:CALL_PUT_RATIO",
    "OPT:IVX:30", "OPT:IVX:90", "OPT:IVX:180", "OPT:IVR:30", "OPT:IVR:90",
)
# Clip range of the interest ratio; each filled column answers to its group's flag.
COVERED_BY = {c: FLAGS[{"OI": 0, "VOL": 1, "IVX": 2, "IVR": 3}[c.split(":")[1]]] for c in SURFACE_FEATURES}
RATIO_RANGE = (0.05, 20.0)
RATIO_EPS = 1e-6


def surface_features(merged: DataFrame) -> DataFrame:
    """Fill policy of the surface features on a bars ⨝ surface frame that has ``_rn``.

    Levels are carried forward without limit and back for two rows; the interest ratio is derived
    where absent and clipped; absent volume is 0; flags fall where a value stays absent.
    """
    call, put = q("OPT:OI:CALL"), q("OPT:OI:PUT")
    vcall, vput = q("OPT:VOL:CALL"), q("OPT:VOL:PUT")
    out = merged.withColumns({
        "OPT:OI:CALL_PUT_RATIO": F.coalesce(q("OPT:OI:CALL_PUT_RATIO"), F.when(F.abs(put) > RATIO_EPS, call / put)),
        "OPT:VOL:TOTAL": F.coalesce(q("OPT:VOL:TOTAL"), F.lit(0.0)),
        "OPT:VOL:CALL_PUT_RATIO": F.coalesce(q("OPT:VOL:CALL_PUT_RATIO"), vcall / F.greatest(vput, F.lit(RATIO_EPS))),
    })
    filled = [c for c in SURFACE_FEATURES if ":VOL:" not in c]
    # names without colons while windows run
    plain = {c: "_s_" + c.replace(":", "_") for c in filled}
    work = checkpointed(out.withColumns({p: q(c) for c, p in plain.items()}))
    carried = running(work, ["symbol"], {p + "_f": ("last", p) for p in plain.values()})

    def back(f, w):
        return {p: F.coalesce(F.col(p + "_f"), F.first(p + "_f", ignorenulls=True).over(f(0, 2))) for p in plain.values()}

    out = rolling(carried, ["symbol"], back, fwd=2)
    cells = {c: F.col(p) for c, p in plain.items()}
    cells["OPT:OI:CALL_PUT_RATIO"] = F.greatest(F.lit(RATIO_RANGE[0]), F.least(F.lit(RATIO_RANGE[1]), F.col(plain["OPT:OI:CALL_PUT_RATIO"])))
    cells["OPT:OI:CALL_PUT_RATIO"] = F.when(F.col(plain["OPT:OI:CALL_PUT_RATIO"]).isNotNull(), cells["OPT:OI:CALL_PUT_RATIO"])
    out = out.withColumns(cells).drop(*plain.values(), *[p + "_f" for p in plain.values()])
    flags: dict[str, Column] = {}
    for c, flag in COVERED_BY.items():
        flags[flag] = flags.get(flag, q(flag)) & q(c).isNotNull()
    dense = F.lit(True)
    for c in SURFACE_FEATURES:
        dense = dense & q(c).isNotNull()
    flags[FLAGS[-1]] = q(FLAGS[-1]) & dense
    return out.withColumns(flags)
