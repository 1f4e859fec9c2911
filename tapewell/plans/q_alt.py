"""Queries: fundamentals, options, surfaces, insiders and the named feature sets."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from tapewell.operators import fundamentals as fu, insiders as ins, options as op
from tapewell.operators import features as ft
from tapewell.operators.calendars import dense_grid, union_calendar
from tapewell.operators.keyed import RN
from tapewell.plans import registry
from tapewell.plans.catalog import CTES, cte, query
from tapewell.session import checkpointed
from tapewell.sources.tables import DAY, Tables

# -- fundamentals ----------------------------------------------------------------------------

cte("seg_bars", """
SELECT c_mktsegment AS symbol, o_orderdate AS ts, arg_max(o_totalprice, o_orderkey) AS close, CAST(count(*) AS DOUBLE) AS volume
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2
""")
cte("known_sql", """
WITH q AS (SELECT symbol, report_date, CASE WHEN count(revenue) OVER r = 4 THEN sum(revenue) OVER r END AS r, CASE WHEN count(net_income) OVER r = 4 THEN sum(net_income) OVER r END AS n
  FROM filings WHERE period = 'quarterly' WINDOW r AS (PARTITION BY symbol ORDER BY report_date ROWS 3 PRECEDING)),
d AS (SELECT symbol, report_date, arg_max(filing_date, period) AS as_of_date, arg_max(total_assets, period) AS total_assets, max(revenue) FILTER (WHERE period = 'annual') AS ar, max(net_income) FILTER (WHERE period = 'annual') AS an FROM filings GROUP BY 1, 2)
SELECT d.symbol, d.report_date, as_of_date, coalesce(q.r, last_value(ar IGNORE NULLS) OVER w) AS fund_ttm_revenue, coalesce(q.n, last_value(an IGNORE NULLS) OVER w) AS fund_ttm_net_income, total_assets AS fund_total_assets
FROM d LEFT JOIN q USING (symbol, report_date) WINDOW w AS (PARTITION BY d.symbol ORDER BY d.report_date ROWS UNBOUNDED PRECEDING)
""")
cte("asof_sql", """
SELECT symbol, ts, close, as_of_date, CASE WHEN NOT fund_stale THEN fund_ttm_revenue END AS fund_ttm_revenue, CASE WHEN NOT fund_stale THEN fund_ttm_net_income END AS fund_ttm_net_income,
  CASE WHEN NOT fund_stale THEN fund_total_assets END AS fund_total_assets, fund_stale, as_of_date IS NOT NULL AND NOT fund_stale AS fund_row_valid FROM (
  SELECT b.symbol, b.ts, b.close, k.as_of_date, fund_ttm_revenue, fund_ttm_net_income, fund_total_assets, coalesce(date_diff('day', CAST(k.as_of_date AS DATE), CAST(b.ts AS DATE)) > 60, false) AS fund_stale
  FROM seg_bars b ASOF LEFT JOIN known_sql k ON b.symbol = k.symbol AND b.ts >= k.as_of_date)
""")
FLOWS, BALANCES = ("revenue", "net_income"), ("total_assets",)


def seg_bars(t: Tables):
    return t.segment_bars().withColumn("ts", F.col("day").cast("timestamp")).select("symbol", "ts", "close", "volume")


def known(t: Tables):
    return fu.known_statements(t.filings(), FLOWS, BALANCES)


@query("a34_trailing_statements", "symbol report_date:d as_of_date:d fund_ttm_revenue:f2 fund_ttm_net_income:f2 fund_total_assets:f", "SELECT * FROM known_sql")
def _(t):
    return known(t)


@query("j02_asof_fundamentals", "symbol ts:t close:f2 as_of_date:d fund_ttm_revenue:f2 fund_total_assets:f fund_stale:b fund_row_valid:b", "SELECT * FROM asof_sql")
def _(t):
    """Latest statement known at each bar; the age limit is 60 days so that staleness occurs here."""
    return fu.attach_fundamentals(seg_bars(t), known(t), stale_days=60)


@query("j08_statement_join", "symbol report_period period fiscal_period income_revenue:f2 balance_total_assets:f cashflow_net_income:f2 currency", """
WITH f AS (SELECT symbol, CAST(report_date AS VARCHAR) AS report_period, period, CASE WHEN period = 'annual' THEN '' ELSE 'Q' END AS fiscal_period, revenue, total_assets, net_income, month(report_date) AS m FROM filings)
SELECT symbol, report_period, period, fiscal_period, CASE WHEN m <> 3 THEN revenue END AS income_revenue, CASE WHEN m <> 6 THEN total_assets END AS balance_total_assets, CASE WHEN m <> 9 THEN net_income END AS cashflow_net_income,
  CASE WHEN m <> 3 THEN 'USD' ELSE 'EUR' END AS currency FROM f
""")
def _(t):
    """Three statements per period, each missing in one quarter."""
    f = t.filings().select("symbol", F.col("report_date").cast("string").alias("report_period"), "period",
                           F.when(F.col("period") == "quarterly", "Q").alias("fiscal_period"), *FLOWS, "total_assets", F.month("report_date").alias("m"))
    keys = list(fu.STATEMENT_KEYS)
    return fu.combine_statements(
        f.filter("m <> 3").select(*keys, "revenue", F.lit("USD").alias("currency")),
        f.filter("m <> 6").select(*keys, "total_assets", F.lit("EUR").alias("currency")),
        f.filter("m <> 9").select(*keys, "net_income"),
    )


# -- options ---------------------------------------------------------------------------------

cte("opt_rows", """
SELECT 'O:' || CAST(l_partkey AS VARCHAR) AS option_symbol, CAST(l_shipdate AS DATE) AS date, p_brand AS underlying,
  CASE WHEN p_size % 7 = 0 THEN NULL WHEN p_size % 2 = 0 THEN 'call' ELSE 'put' END AS option_type, sum(l_quantity) AS open_interest, CAST(count(*) AS DOUBLE) AS volume
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3, 4
""")
cte("oi_sql", """
SELECT underlying, date, sum(open_interest) AS oi_total, sum(open_interest) FILTER (WHERE option_type = 'call') AS oi_call_total, sum(open_interest) FILTER (WHERE option_type = 'put') AS oi_put_total,
  sum(open_interest) FILTER (WHERE r <= 10) / sum(open_interest) AS oi_concentration_top10,
  (sum(open_interest) FILTER (WHERE option_type = 'put') + 1e-9) / (sum(open_interest) FILTER (WHERE option_type = 'call') + 1e-9) AS oi_put_call_ratio
FROM (SELECT *, row_number() OVER (PARTITION BY underlying, date ORDER BY open_interest DESC, option_symbol) AS r FROM opt_rows WHERE option_type IS NOT NULL) GROUP BY 1, 2
""")
cte("ov_sql", """
SELECT underlying, date, sum(volume) AS options_volume_total, sum(volume) FILTER (WHERE option_type = 'call') AS options_volume_call_total, sum(volume) FILTER (WHERE option_type = 'put') AS options_volume_put_total
FROM opt_rows GROUP BY 1, 2
""")


def typed(t: Tables):
    return op.typed(t.option_interest(), t.option_reference())


@query("j05_option_type_lookup", "option_symbol underlying date:d option_type open_interest:f", "SELECT * FROM opt_rows")
def _(t):
    return typed(t)


@query("a01_daily_open_interest", "underlying date:d oi_total:f oi_call_total:f oi_put_total:f oi_put_call_ratio:f", "SELECT * FROM oi_sql")
def _(t):
    return op.daily_interest(typed(t))


@query("a02_interest_concentration", "underlying date:d oi_concentration_top10:f", "SELECT * FROM oi_sql")
def _(t):
    return op.daily_interest(typed(t))


BY_TYPE_SQL = """
SELECT option_type AS underlying, date, sum(open_interest) FILTER (WHERE r <= 10) / sum(open_interest) AS oi_concentration_top10
FROM (SELECT *, row_number() OVER (PARTITION BY option_type, date ORDER BY open_interest DESC, option_symbol) AS r FROM opt_rows WHERE option_type IS NOT NULL) GROUP BY 1, 2
"""


@query("l02_top_contracts", "underlying date:d oi_concentration_top10:f", BY_TYPE_SQL)
def _(t):
    """Ten largest contracts per day within calls and puts of the whole market."""
    return op.daily_interest(typed(t).withColumn("underlying", F.col("option_type")))


@query("a03_daily_option_volume", "underlying date:d options_volume_total:f options_volume_call_total:f options_volume_put_total:f", "SELECT * FROM ov_sql")
def _(t):
    return op.daily_volume(typed(t))


@query("j07_interest_full_volume", "underlying date:d oi_total:f options_volume_total:f", """
SELECT coalesce(o.underlying, v.underlying) AS underlying, coalesce(o.date, v.date) AS date, oi_total, options_volume_total FROM oi_sql o FULL JOIN ov_sql v ON o.underlying = v.underlying AND o.date = v.date
""")
def _(t):
    rows = typed(t)
    return op.daily_options(op.daily_interest(rows), op.daily_volume(rows))


cte("grid_d", """
SELECT s.symbol, c.ts, CAST(c.ts AS DATE) AS date FROM (SELECT symbol, min(ts) AS a FROM bars_d GROUP BY 1) s JOIN day_cal c ON c.ts >= s.a
""")
cte("options_v1_sql", """
SELECT *, coalesce((oi_put_total + 1e-9) / (oi_call_total + 1e-9), 1) AS oi_put_call_ratio, coalesce(oi_total - lag(oi_total) OVER w, 0) AS oi_change_1d,
  coalesce((oi_total - lag(oi_total) OVER w) / (lag(oi_total) OVER w + 1e-9), 0) AS oi_change_pct_1d FROM (
  SELECT g.symbol, g.ts, last_value(oi_total IGNORE NULLS) OVER f AS oi_total, last_value(oi_call_total IGNORE NULLS) OVER f AS oi_call_total, last_value(oi_put_total IGNORE NULLS) OVER f AS oi_put_total,
    coalesce(last_value(oi_concentration_top10 IGNORE NULLS) OVER f, 0) AS oi_concentration_top10, coalesce(options_volume_total, 0) AS options_volume_total,
    coalesce(options_volume_call_total, 0) AS options_volume_call_total, coalesce(options_volume_put_total, 0) AS options_volume_put_total
  FROM grid_d g LEFT JOIN oi_sql o ON o.underlying = g.symbol AND o.date = g.date LEFT JOIN ov_sql v ON v.underlying = g.symbol AND v.date = g.date
  WINDOW f AS (PARTITION BY g.symbol ORDER BY g.ts ROWS 2 PRECEDING)) WINDOW w AS (PARTITION BY symbol ORDER BY ts)
""")


def option_days(t: Tables):
    rows = typed(t)
    return op.daily_options(op.daily_interest(rows), op.daily_volume(rows))


def brand_grid(t: Tables):
    """Sessions of the whole market per brand, so that days without contracts occur."""
    bars = t.bars_d()
    grid = dense_grid(bars, union_calendar(bars, DAY), ["close", "volume"])
    return grid.drop("sid")


OPT_SPEC = "symbol ts:t oi_total:f oi_call_total:f oi_put_total:f oi_put_call_ratio:f4 oi_concentration_top10:f oi_change_1d:f oi_change_pct_1d:f options_volume_total:f options_volume_call_total:f options_volume_put_total:f"


@query("w22_interest_change", "symbol ts:t oi_total:f oi_change_1d:f oi_change_pct_1d:f", "SELECT * FROM options_v1_sql")
def _(t):
    return op.options_v1(brand_grid(t).withColumn("date", F.col("ts").cast("date")), option_days(t))


@query("fs_options_v1", OPT_SPEC, "SELECT * FROM options_v1_sql")
def _(t):
    return registry.build("options_v1", registry.Inputs(brand_grid(t), DAY, options=option_days(t)))


# -- surfaces --------------------------------------------------------------------------------


OTHER_IVX, OTHER_IVR, OTHER_HV = (60, 120, 150), (60, 120, 150, 180), tuple(n for n in op.HV_DAYS if n != 20)


def raw_surface(t: Tables):
    """Segment days as vendor surface rows: text numbers, percent volatilities, gaps and negatives."""
    b = t.segment_bars()
    k = F.dayofyear("day")
    pct = F.col("close") / 1000.0
    return b.select(
        F.lower("symbol").alias("ticker"), F.col("day").cast("string").alias("tradeDate"),
        F.when(k % 9 != 0, F.format_number(F.col("volume") * 1000, 0)).alias("callOI"),
        F.when(k % 7 == 0, -1.0).when(k % 9 != 0, F.col("volume") * 3).alias("put_open_interest"),
        F.when(k % 2 == 0, F.col("volume") * 10).alias("optVolCall"), F.when(k % 3 == 0, 0.0).otherwise(F.col("volume")).alias("optVolPut"),
        F.lit(1.5).alias("callPutVolumeRatio"),
        F.when(k % 5 != 0, pct).alias("ivx30"), pct.alias("IVX90"), F.when(k % 4 != 0, pct * 1.2).alias("ivx_180"),
        (k * 0.25).cast("string").alias("ivr_30"), F.when(k % 6 != 0, k * 0.5).alias("IVR90"), (pct * 0.9).alias("hv20"),
        *[(pct * (1 + n / 1000)).alias(f"IVX{n}") for n in OTHER_IVX], *[(k * 0.25 + n / 100).alias(f"ivr{n}") for n in OTHER_IVR],
        *[F.when(k % 8 != 0, (k + n) * 0.1).alias(f"ivp_{n}") for n in op.TENORS], *[F.when(k % 10 != 0, pct * (0.8 + n / 1000)).alias(f"HV{n}") for n in OTHER_HV],
    )


cte("raw_surface_sql", """
SELECT symbol, CAST(ts AS DATE) AS date, close / 1000.0 AS pct, dayofyear(ts) AS k, volume FROM seg_bars
""")
_RANGED = [f"i{n}" for n in op.TENORS] + [f"h{n}" for n in op.HV_DAYS]


def _surface_sql() -> str:
    given = {"i30": "CASE WHEN k % 5 <> 0 THEN pct END", "i90": "pct", "i180": "CASE WHEN k % 4 <> 0 THEN pct * 1.2 END", "r30": "k * 0.25", "r90": "CASE WHEN k % 6 <> 0 THEN k * 0.5 END", "h20": "CASE WHEN true THEN pct * 0.9 END"}
    given |= {f"i{n}": f"pct * {1 + n / 1000}" for n in OTHER_IVX} | {f"r{n}": f"k * 0.25 + {n / 100}" for n in OTHER_IVR}
    given |= {f"p{n}": f"CASE WHEN k % 8 <> 0 THEN (k + {n}) * 0.1 END" for n in op.TENORS} | {f"h{n}": f"CASE WHEN k % 10 <> 0 THEN pct * {0.8 + n / 1000} END" for n in OTHER_HV}
    seen = lambda letter: "(" + " OR ".join(f"{c} <= 500" for c in _RANGED if c[0] == letter) + ") IS TRUE"
    wild = " OR ".join([*[f"coalesce({c} > 500, false)" for c in _RANGED], *[f"coalesce({c} NOT BETWEEN 0 AND 5, false)" for c in ("s90", "s180")]])
    return f"""
WITH a AS (SELECT symbol, date, CASE WHEN k % 9 <> 0 THEN volume * 1000 END AS oic, CASE WHEN k % 7 = 0 THEN NULL WHEN k % 9 <> 0 THEN volume * 3 END AS oip, CASE WHEN k % 2 = 0 THEN volume * 10 END AS vc,
    CASE WHEN k % 3 = 0 THEN 0.0 ELSE volume END AS vp, k, {", ".join(f"{e} AS {c}" for c, e in given.items())} FROM raw_surface_sql),
b AS (SELECT *, (i90 - i30) / 100 AS s90, (i180 - i30) / 100 AS s180 FROM a)
SELECT symbol, date, oic, oip, CASE WHEN oic IS NOT NULL OR oip IS NOT NULL THEN coalesce(oic, 0) + coalesce(oip, 0) END AS oit, oic / nullif(oip, 0) AS oir, vc, vp, coalesce(vc, 0) + vp AS vt, coalesce(vc / nullif(vp, 0), 1.5) AS vr,
  {", ".join(f"CASE WHEN {c} <= 500 THEN {c} / 100 END AS {c}" for c in _RANGED)}, CASE WHEN s90 BETWEEN 0 AND 5 THEN s90 END AS s90, CASE WHEN s180 BETWEEN 0 AND 5 THEN s180 END AS s180,
  {", ".join(c for c in given if c[0] in "rp")}, (oic IS NOT NULL OR oip IS NOT NULL) AS has_oi, true AS has_vol, {seen("i")} AS has_ivx, true AS has_ivr, (p30 IS NOT NULL) AS has_ivp, {seen("h")} AS has_hv,
  NOT ((k % 7 = 0) OR {wild}) AS row_valid
FROM b
"""


cte("surface_sql", _surface_sql())


def surface(t: Tables):
    return op.normalize_surface(raw_surface(t))


SHORT = {
    "OPT:OI:CALL": "oic", "OPT:OI:PUT": "oip", "OPT:OI:TOTAL": "oit", "OPT:OI:CALL_PUT_RATIO": "oir", "OPT:VOL:CALL": "vc", "OPT:VOL:PUT": "vp", "OPT:VOL:TOTAL": "vt",
    "OPT:VOL:CALL_PUT_RATIO": "vr", "OPT:IVX:TERM_SLOPE_30_90": "s90", "OPT:IVX:TERM_SLOPE_30_180": "s180",
    **{f"OPT:{kind}:{n}": f"{letter}{n}" for kind, letter, days in (("IVX", "i", op.TENORS), ("IVR", "r", op.TENORS), ("IVP", "p", op.TENORS), ("HV", "h", op.HV_DAYS)) for n in days},
    "OPT:COVERAGE:HAS_OI": "has_oi", "OPT:COVERAGE:HAS_OPT_VOLUME": "has_vol", "OPT:COVERAGE:HAS_IVX": "has_ivx", "OPT:COVERAGE:HAS_IVR": "has_ivr",
    "OPT:COVERAGE:HAS_IVP": "has_ivp", "OPT:COVERAGE:HAS_HV": "has_hv", "OPT:COVERAGE:ROW_VALID": "row_valid",
}


def _kind(c: str) -> str:
    return "b" if c in op.FLAGS else "f9" if c.startswith(("OPT:IVX", "OPT:HV")) else "f"


def surface_spec(columns) -> str:
    return " ".join(f"{SHORT[c]}:{_kind(c)}" for c in columns)


def short(df):
    return df.select(*[F.col(f"`{c}`").alias(SHORT.get(c, c)) for c in df.columns])


@query("p08_surface_normalize", f"symbol date:d {surface_spec(op.SURFACE_COLUMNS)}", "SELECT * FROM surface_sql")
def _(t):
    return short(surface(t))


@query("j03_surface_attach", "symbol ts:t oit:f i30:f9 has_oi:b row_valid:b", """
SELECT b.symbol, b.ts, oit, i30, coalesce(has_oi, false) AS has_oi, coalesce(row_valid, false) AS row_valid FROM seg_bars b LEFT JOIN surface_sql s ON s.symbol = b.symbol AND s.date = CAST(b.ts AS DATE) - 1
""")
def _(t):
    """Surface of the calendar day before, so that absent days occur."""
    bars = seg_bars(t).withColumn("date", F.date_sub(F.col("ts").cast("date"), 1))
    return short(op.attach_surface(bars.withColumn("d2", F.col("date")).drop("date"), surface(t), "d2"))


cte("prev_sql", "SELECT symbol, ts, close, volume, lag(CAST(ts AS DATE)) OVER (PARTITION BY symbol ORDER BY ts) AS prev FROM seg_bars")


@query("j04_surface_attach_lag1", "symbol ts:t oit:f i30:f9 has_oi:b", """
SELECT b.symbol, b.ts, oit, i30, coalesce(has_oi, false) AS has_oi FROM prev_sql b LEFT JOIN surface_sql s ON s.symbol = b.symbol AND s.date = b.prev
""")
def _(t):
    bars = op.previous_session(seg_bars(t).withColumn("date", F.col("ts").cast("date")))
    return short(op.attach_surface(bars, surface(t), "prev_date"))


def _fill(c: str) -> str:
    return f"coalesce({c}_f, first_value({c}_f IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)) AS {c}"


def _features_sql(on: str) -> str:
    carry = ", ".join(f"last_value({c} IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING) AS {c}_f" for c in ("oit", "oir", "i30", "i90", "i180", "r30", "r90"))
    return f"""
SELECT symbol, ts, oit, greatest(0.05, least(20, oir)) * CASE WHEN oir IS NULL THEN NULL ELSE 1 END AS oir, vt, vr, i30, i90, i180, r30, r90, has_oi AND oit IS NOT NULL AND oir IS NOT NULL AS has_oi, has_vol AND vr IS NOT NULL AS has_vol,
  has_ivp, has_hv,
  has_ivx AND i30 IS NOT NULL AND i90 IS NOT NULL AND i180 IS NOT NULL AS has_ivx, has_ivr AND r30 IS NOT NULL AND r90 IS NOT NULL AS has_ivr,
  row_valid AND oit IS NOT NULL AND oir IS NOT NULL AND vr IS NOT NULL AND i30 IS NOT NULL AND i90 IS NOT NULL AND i180 IS NOT NULL AND r30 IS NOT NULL AND r90 IS NOT NULL AS row_valid FROM (
  SELECT symbol, ts, vt, vr, has_oi, has_vol, has_ivx, has_ivr, has_ivp, has_hv, row_valid, {', '.join(_fill(c) for c in ('oit', 'oir', 'i30', 'i90', 'i180', 'r30', 'r90'))} FROM (
    SELECT symbol, ts, vt, vr, has_oi, has_vol, has_ivx, has_ivr, has_ivp, has_hv, row_valid, {carry} FROM (
      SELECT b.symbol, b.ts, oit, coalesce(oir, CASE WHEN abs(oip) > 1e-6 THEN oic / oip END) AS oir, coalesce(vt, 0) AS vt, coalesce(vr, vc / greatest(vp, 1e-6)) AS vr, i30, i90, i180, r30, r90,
        coalesce(has_oi, false) AS has_oi, coalesce(has_vol, false) AS has_vol, coalesce(has_ivx, false) AS has_ivx, coalesce(has_ivr, false) AS has_ivr, coalesce(has_ivp, false) AS has_ivp, coalesce(has_hv, false) AS has_hv, coalesce(row_valid, false) AS row_valid
      FROM prev_sql b LEFT JOIN surface_sql s ON s.symbol = b.symbol AND s.date = {on})))
"""


cte("surf_feat_sql", _features_sql("CAST(b.ts AS DATE)"))
cte("surf_feat_lag_sql", _features_sql("b.prev"))
SURF = surface_spec((*op.SURFACE_FEATURES, *op.FLAGS))


# -- insiders --------------------------------------------------------------------------------

cte("adv_sql", """
SELECT symbol, ts, CAST(ts AS DATE) AS day, close, volume, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS rn,
  CASE WHEN count(*) OVER r = 20 THEN avg(close * volume) OVER r END AS adv FROM seg_bars WINDOW r AS (PARTITION BY symbol ORDER BY ts ROWS 19 PRECEDING)
""")
cte("chosen_sql", """
SELECT t.*, a.rn, a.adv, CASE WHEN regexp_matches(upper(title), 'CEO|CFO|CHAIRMAN') THEN 3.0 WHEN is_board_director THEN 2.0 ELSE 1.0 END AS role_weight
FROM insider_trades t JOIN adv_sql a ON a.symbol = t.symbol AND a.day = t.filing_date
WHERE a.adv > 0 AND (regexp_matches(upper(title), 'CEO|CFO|COO|CTO|PRESIDENT|CHAIRMAN') OR is_board_director) AND security_title = 'Common Stock' AND value >= a.adv * 0.001
""")
cte("flows_sql", """
SELECT a.symbol, a.ts, a.rn, coalesce(sum(value) FILTER (WHERE shares > 0), 0) AS buy, coalesce(sum(value) FILTER (WHERE shares < 0), 0) AS sell, coalesce(sum(role_weight * value / c.adv) FILTER (WHERE shares > 0), 0) AS score
FROM adv_sql a LEFT JOIN chosen_sql c ON c.symbol = a.symbol AND c.rn = a.rn GROUP BY 1, 2, 3
""")
PAST = [f"lag(b30, {756 - 30 * k}) OVER w" for k in range(25)]
cte("insider_sql", f"""
SELECT symbol, ts, rn, (b30 - s30) / (b30 + s30 + 1) AS insider_filtered_bsr_30d, cl AS insider_cluster_score_10d,
  CASE WHEN rn >= 786 THEN CASE WHEN b30 = 0 AND {' AND '.join(f'{p} = 0' for p in PAST)} THEN 0.5 ELSE ({' + '.join(f'CAST({p} <= b30 AS INT)' for p in PAST)}) / 25.0 END END AS insider_intensity_pctl_30d
FROM (SELECT symbol, ts, rn, sum(buy) OVER (PARTITION BY symbol ORDER BY ts ROWS 29 PRECEDING) AS b30, sum(sell) OVER (PARTITION BY symbol ORDER BY ts ROWS 29 PRECEDING) AS s30, sum(score) OVER (PARTITION BY symbol ORDER BY ts ROWS 9 PRECEDING) AS cl FROM flows_sql)
WINDOW w AS (PARTITION BY symbol ORDER BY ts)
""")
cte("own_sql", """
SELECT a.symbol, a.ts, coalesce(d.delta, 0) AS insider_ownership_delta_30d FROM adv_sql a LEFT JOIN (
  SELECT symbol, rn, quantile_cont((a - b) / b, 0.5) AS delta FROM (
    SELECT s.symbol, s.rn, c.name, first(c."before" ORDER BY c.rn, c.id) AS b, first(c."after" ORDER BY c.rn DESC, c.id) AS a
    FROM adv_sql s JOIN chosen_sql c ON c.symbol = s.symbol AND c.rn BETWEEN s.rn - 29 AND s.rn GROUP BY 1, 2, 3) WHERE b > 0 GROUP BY 1, 2) d ON d.symbol = a.symbol AND d.rn = a.rn
""")


def seg_numbered(t: Tables):
    return ft.numbered_bars(seg_bars(t), DAY).withColumn("day", F.col("ts").cast("date"))


@query("a07_average_dollar_volume", "symbol ts:t adv:f5", "SELECT * FROM adv_sql")
def _(t):
    return ins.dollar_volume(seg_numbered(t))


@query("p06_insider_relevance", "symbol id:i filing_date:d name role_weight:f adv:f5", "SELECT * FROM chosen_sql")
def _(t):
    return ins.relevant(t.insider_trades(), ins.dollar_volume(seg_numbered(t)))


@query("a08_insider_flows", "symbol rn:i buy:f2 sell:f2 score:f", "SELECT * FROM flows_sql")
def _(t):
    adv = checkpointed(ins.dollar_volume(seg_numbered(t)))
    flows = ins.session_flows(ins.relevant(t.insider_trades(), adv)).select("symbol", RN, "buy", "sell", "score")
    return adv.select("symbol", RN).join(flows, ["symbol", RN], "left").fillna(0.0).withColumn("rn", F.col(RN))


@query("w23_insider_ratio", "symbol ts:t insider_filtered_bsr_30d:f insider_cluster_score_10d:f", "SELECT * FROM insider_sql")
def _(t):
    return ins.insiders_v1(seg_numbered(t), t.insider_trades())


@query("w24_ownership_delta", "symbol ts:t insider_ownership_delta_30d:f", "SELECT * FROM own_sql")
def _(t):
    return ins.insiders_v1(seg_numbered(t), t.insider_trades())


@query("w25_insider_intensity", "symbol ts:t insider_intensity_pctl_30d:f", "SELECT * FROM insider_sql")
def _(t):
    return ins.insiders_v1(seg_numbered(t), t.insider_trades())


# -- named feature sets ----------------------------------------------------------------------

# The per-symbol and market CTEs once more, over the daily segment bars.
_NAMES = ["bars_h", "core_sql", "sma_sql", "panel_cal", "panel_sql", "xret_sql", "xsec_sql", "market_ts_sql", "corr_sql", "market_sql"]


def _over(suffix: str, bars: str) -> None:
    rename = {n: (bars if n == "bars_h" else f"{n}_{suffix}") for n in _NAMES}
    for n in _NAMES[1:]:
        cte(rename[n], re.sub(r"\b(" + "|".join(_NAMES) + r")\b", lambda m: rename[m.group(1)], CTES[n]))


_over("g", "seg_bars")
cte("seg3", "SELECT * FROM panel_sql_g WHERE symbol IN ('BUILDING', 'FURNITURE', 'MACHINERY')")
for _n in ("xret_sql", "market_ts_sql", "corr_sql", "market_sql"):
    cte(f"{_n}_u", re.sub(r"\b(xret_sql|market_ts_sql|corr_sql|market_sql)\b", r"\1_u", CTES[_n]).replace("panel_sql", "seg3"))

CORE = "ret_1:f ret_5:f ret_21:f rv_21:f rv_63:f dist_from_20d_high:f dist_from_20d_low:f log_vol_z20:f4"
XS = "ret_1d:f ret_5d:f vol_10d:f sma_20_dist:f ret_1d_z:f4 ret_5d_z:f4 vol_10d_z:f3 volume_zscore_20d:f4 rel_strength_20d:f trend_strength_20d:f4 ret_1d_rank:f ret_5d_rank:f liquidity_rank:f"
XM = "market_ret_1d:f market_vol_20d:f market_vol_of_vol_20d:f dispersion_1d:f dispersion_5d:f breadth_up_1d:f breadth_down_1d:f breadth_up_5d:f corr_mean_20d:f corr_spike_20d:f"
RG = "market_vol_20d:f market_trend_20d:f dispersion_20d:f corr_mean_20d:f"
FU = "fund_ttm_revenue:f2 fund_ttm_net_income:f2 fund_total_assets:f fund_row_valid:b fund_stale:b"
SM = "close:f2 sma_fast:f5 sma_slow:f5 sma_diff:f5 sma_signal:f"
# statements older than the registry's 180 days do not occur in dense filings; the twin keeps the rule
cte("asof180_sql", CTES["asof_sql"].replace("> 60", "> 180"))


def inputs(t: Tables, **kw) -> registry.Inputs:
    return registry.Inputs(seg_bars(t), DAY, statements=t.filings(), trades=t.insider_trades(), surface=surface(t), **kw)


def feature_query(name: str, spec: str, sql: str) -> None:
    def run(t: Tables):
        return short(registry.build(name, inputs(t)))

    run.__doc__ = f"Feature set {name} over the daily segment bars."
    query(f"fs_{name}", spec, sql)(run)


XJ = "JOIN xsec_sql_g x USING (symbol, ts) JOIN market_sql_g m ON m.ts = x.ts"
feature_query("sma_v1", f"symbol ts:t {SM}", "SELECT *, sma_fast - sma_slow AS sma_diff FROM sma_sql_g WHERE sma_fast IS NOT NULL AND sma_slow IS NOT NULL")
feature_query("core_v1", f"symbol ts:t {CORE}", "SELECT * FROM core_sql_g")
feature_query("core_v1_fundamentals_v1", f"symbol ts:t {CORE} {FU}", "SELECT * FROM core_sql_g JOIN (SELECT * EXCLUDE (close) FROM asof180_sql) USING (symbol, ts)")
feature_query("insiders_v1", "symbol ts:t insider_filtered_bsr_30d:f insider_cluster_score_10d:f insider_intensity_pctl_30d:f insider_ownership_delta_30d:f", "SELECT * FROM insider_sql JOIN own_sql USING (symbol, ts)")
feature_query("options_surface_v1", f"symbol ts:t {SURF}", "SELECT * FROM surf_feat_sql")
feature_query("options_surface_v1_lag1", f"symbol ts:t {SURF}", "SELECT * FROM surf_feat_lag_sql")
feature_query("equity_xsec_v1", f"symbol ts:t {XS} {XM}", "SELECT x.*, m.* EXCLUDE (ts, rn) FROM xsec_sql_g x JOIN market_sql_g m ON m.ts = x.ts")
feature_query("sma_plus_xsec_v1", f"symbol ts:t {SM} {XS} {XM}", f"SELECT s.symbol, s.ts, s.close, sma_fast, sma_slow, sma_fast - sma_slow AS sma_diff, sma_signal, x.* EXCLUDE (symbol, ts, rn, close), m.* EXCLUDE (ts, rn) FROM sma_sql_g s {XJ} WHERE sma_fast IS NOT NULL AND sma_slow IS NOT NULL")
feature_query("core_v1_xsec", f"symbol ts:t {CORE} {XS} {XM}", f"SELECT c.*, x.* EXCLUDE (symbol, ts, rn, close), m.* EXCLUDE (ts, rn) FROM core_sql_g c {XJ}")
feature_query("core_v1_regime", f"symbol ts:t {CORE} {RG}", "SELECT c.*, m.* EXCLUDE (ts, rn) FROM core_sql_g c JOIN market_sql_g m ON m.ts = c.ts")
feature_query("core_v1_xsec_regime", f"symbol ts:t {CORE} {XS} {XM} market_trend_20d:f dispersion_20d:f", f"SELECT c.*, x.* EXCLUDE (symbol, ts, rn, close), m.* EXCLUDE (ts, rn) FROM core_sql_g c {XJ}")
feature_query("core_v1_xsec_regime_opts_v1", f"symbol ts:t {CORE} {XS} {XM} {SURF} market_trend_20d:f dispersion_20d:f", f"SELECT c.*, x.* EXCLUDE (symbol, ts, rn, close), m.* EXCLUDE (ts, rn), s.* EXCLUDE (symbol, ts) FROM core_sql_g c {XJ} JOIN surf_feat_sql s ON s.symbol = c.symbol AND s.ts = c.ts")
feature_query("core_v1_xsec_regime_opts_v1_lag1", f"symbol ts:t {CORE} {XS} {XM} {SURF} market_trend_20d:f dispersion_20d:f", f"SELECT c.*, x.* EXCLUDE (symbol, ts, rn, close), m.* EXCLUDE (ts, rn), s.* EXCLUDE (symbol, ts) FROM core_sql_g c {XJ} JOIN surf_feat_lag_sql s ON s.symbol = c.symbol AND s.ts = c.ts")
feature_query("core_v1_fundamentals_regime_v1", f"symbol ts:t {CORE} {FU} {RG}", "SELECT c.*, f.* EXCLUDE (symbol, ts, close), m.* EXCLUDE (ts, rn) FROM core_sql_g c JOIN asof180_sql f ON f.symbol = c.symbol AND f.ts = c.ts JOIN market_sql_g m ON m.ts = c.ts")
feature_query("core_v1_fundamentals_regime_xsec_v1", f"symbol ts:t {CORE} {FU} {XS} {XM} market_trend_20d:f dispersion_20d:f", f"SELECT c.*, f.* EXCLUDE (symbol, ts, close), x.* EXCLUDE (symbol, ts, rn, close), m.* EXCLUDE (ts, rn) FROM core_sql_g c {XJ} JOIN asof180_sql f ON f.symbol = c.symbol AND f.ts = c.ts")
feature_query("core_v1_fundamentals_regime_opts_v1", f"symbol ts:t {CORE} {FU} {SURF} {RG}", "SELECT c.*, f.* EXCLUDE (symbol, ts, close), s.* EXCLUDE (symbol, ts), m.* EXCLUDE (ts, rn) FROM core_sql_g c JOIN asof180_sql f ON f.symbol = c.symbol AND f.ts = c.ts JOIN surf_feat_sql s ON s.symbol = c.symbol AND s.ts = c.ts JOIN market_sql_g m ON m.ts = c.ts")
feature_query("regime_v1", f"ts:t {RG}", "SELECT * FROM market_sql_g")


@query("fs_regime_v1_1", f"ts:t {RG}", "SELECT * FROM market_sql_u")
def _(t):
    """Regime on a fixed set of primary symbols."""
    return registry.build("regime_v1_1", inputs(t, regime_universe=("BUILDING", "FURNITURE", "MACHINERY")))


@query("fs_sma_universe_v1", "symbol ts:t close:f sma_fast:f sma_slow:f sma_diff:f sma_signal:f", "SELECT *, sma_fast - sma_slow AS sma_diff FROM sma_sql WHERE sma_fast IS NOT NULL AND sma_slow IS NOT NULL")
def _(t):
    return registry.build("sma_universe_v1", registry.Inputs(t.bars_h(), 3600))


@query("fs_sma_plus_options_v1", "symbol ts:t close:f8 sma_fast:o4 sma_slow:o4 sma_diff:o4 sma_signal:f " + OPT_SPEC.removeprefix("symbol ts:t "), """
WITH s AS (SELECT symbol, ts, close, CASE WHEN count(*) OVER f = 5 THEN avg(close) OVER f END AS sma_fast, CASE WHEN count(*) OVER s = 20 THEN avg(close) OVER s END AS sma_slow FROM bars_d
  WINDOW f AS (PARTITION BY symbol ORDER BY ts ROWS 4 PRECEDING), s AS (PARTITION BY symbol ORDER BY ts ROWS 19 PRECEDING)),
o AS (SELECT b.symbol, b.ts, last_value(oi_total IGNORE NULLS) OVER f AS oi_total, last_value(oi_call_total IGNORE NULLS) OVER f AS oi_call_total, last_value(oi_put_total IGNORE NULLS) OVER f AS oi_put_total,
    coalesce(last_value(oi_concentration_top10 IGNORE NULLS) OVER f, 0) AS oi_concentration_top10, coalesce(options_volume_total, 0) AS options_volume_total,
    coalesce(options_volume_call_total, 0) AS options_volume_call_total, coalesce(options_volume_put_total, 0) AS options_volume_put_total
  FROM bars_d b LEFT JOIN oi_sql o ON o.underlying = b.symbol AND o.date = CAST(b.ts AS DATE) LEFT JOIN ov_sql v ON v.underlying = b.symbol AND v.date = CAST(b.ts AS DATE) WINDOW f AS (PARTITION BY b.symbol ORDER BY b.ts ROWS 2 PRECEDING)),
c AS (SELECT *, coalesce((oi_put_total + 1e-9) / (oi_call_total + 1e-9), 1) AS oi_put_call_ratio, coalesce(oi_total - lag(oi_total) OVER w, 0) AS oi_change_1d,
    coalesce((oi_total - lag(oi_total) OVER w) / (lag(oi_total) OVER w + 1e-9), 0) AS oi_change_pct_1d FROM o WINDOW w AS (PARTITION BY symbol ORDER BY ts))
SELECT s.*, sma_fast - sma_slow AS sma_diff, CASE WHEN sma_fast > sma_slow THEN 1.0 ELSE 0.0 END AS sma_signal, c.* EXCLUDE (symbol, ts) FROM s JOIN c ON c.symbol = s.symbol AND c.ts = s.ts WHERE sma_fast IS NOT NULL AND sma_slow IS NOT NULL
""")
def _(t):
    return registry.build("sma_plus_options_v1", registry.Inputs(t.bars_d().select("symbol", "ts", "close", "volume"), DAY, options=option_days(t)))


@query("j06_core_join_xsec", "symbol ts:t ret_1:f rv_21:f ret_1d_rank:f sma_20_dist:f", "SELECT * FROM core_sql JOIN (SELECT * EXCLUDE (close) FROM xsec_sql) USING (symbol, ts)")
def _(t):
    return registry.build("core_v1_xsec", registry.Inputs(t.bars_h(), 3600))


@query("fs_universe_panel", "ts:t symbol close:f2 fund_ttm_revenue:f2 market_vol_20d:f", """
SELECT p.ts, p.symbol, p.close, coalesce(rev, 0) AS fund_ttm_revenue, market_vol_20d FROM panel_sql_g p JOIN market_sql_g m ON m.ts = p.ts JOIN (
  SELECT g.symbol, g.ts, last_value(fund_ttm_revenue IGNORE NULLS) OVER (PARTITION BY g.symbol ORDER BY g.ts ROWS 3 PRECEDING) AS rev
  FROM (SELECT s.symbol, c.ts FROM (SELECT DISTINCT symbol FROM seg_bars) s CROSS JOIN panel_cal_g c) g LEFT JOIN asof_sql a ON a.symbol = g.symbol AND a.ts = g.ts) f ON f.symbol = p.symbol AND f.ts = p.ts
""")
def _(t):
    """Features of all symbols on one calendar with the regime state."""
    bars = seg_bars(t)
    feats = fu.attach_fundamentals(bars, known(t), stale_days=60).select("symbol", "ts", "close", "fund_ttm_revenue")
    regime = registry.build("regime_v1", registry.Inputs(bars, DAY))
    return registry.universe_panel(feats, DAY, ["fund_ttm_revenue"], regime)


@query("fs_nested_panel", "ts:t n:i close_building:f2", "SELECT ts, count(*) AS n, max(close) FILTER (WHERE symbol = 'BUILDING') AS close_building FROM panel_sql_g GROUP BY ts")
def _(t):
    """The panel as one map of symbol to features per session."""
    from tapewell.operators.calendars import complete_panel

    nested = registry.nested_panel(complete_panel(seg_bars(t), DAY), ["close", "volume"])
    return nested.select("ts", F.size("panel").alias("n"), F.col("panel")["BUILDING"]["close"].alias("close_building"))
