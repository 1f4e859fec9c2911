"""Column functions: coercion, normalisation, guarded arithmetic, identities."""

from __future__ import annotations

from collections.abc import Collection, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-9


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def blank_to_null(c: Column | str) -> Column:
    return F.nullif(F.trim(col(c).cast("string")), F.lit(""))


def to_float(c: Column | str) -> Column:
    """Number from text with thousands separators; null where it does not parse or is not finite."""
    return finite(F.regexp_replace(blank_to_null(c), ",", "").try_cast("double"))


def finite(n: Column) -> Column:
    return F.when(~F.isnan(n) & (F.abs(n) != float("inf")), n)


def first_present(columns: Sequence[str], candidates: Sequence[str]) -> Column:
    """First non-empty value of the candidate names that exist, lower and upper variants included."""
    by_name = set(columns)
    names: list[str] = []
    for c in candidates:
        for variant in (c, c.lower(), c.upper()):
            if variant in by_name and variant not in names:
                names.append(variant)
    if not names:
        return F.lit(None).cast("string")
    return F.coalesce(*[blank_to_null(f"`{n}`") for n in names])


def first_float(columns: Sequence[str], candidates: Sequence[str], numeric: Collection[str] = ()) -> Column:
    """First candidate column that parses as a number; ``numeric`` names those that are numbers already."""
    names = [c for c in candidates if c in set(columns)]
    values = [finite(F.col(f"`{n}`").cast("double")) if n in numeric else to_float(f"`{n}`") for n in names]
    return F.coalesce(*values) if names else F.lit(None).cast("double")


# Fixed value: epoch numbers above this are milliseconds.
EPOCH_MILLIS_FROM = 1e12


def coerce_timestamp(text: Column | str) -> Column:
    """Timestamp from ISO text (with or without Z), a date, or epoch seconds / milliseconds."""
    t = blank_to_null(text)
    n = t.try_cast("double")
    millis = F.when(n > EPOCH_MILLIS_FROM, n).otherwise(n * 1000.0)
    return F.when(n.isNotNull(), F.timestamp_millis(millis.cast("bigint"))).otherwise(t.try_cast("timestamp"))


def normalize_symbol(c: Column | str) -> Column:
    return F.nullif(F.upper(F.trim(col(c))), F.lit(""))


def normalize_period(period: Column | str, fiscal: Column | str) -> Column:
    """annual / quarterly from the period text, else from the fiscal period's prefix."""
    # Period aliases.
    p = F.lower(F.trim(F.coalesce(col(period), F.lit(""))))
    f = F.upper(F.trim(F.coalesce(col(fiscal), F.lit(""))))
    return (
        F.when(p.isin("quarter", "quarterly", "q", "qtr"), "quarterly")
        .when(p.isin("annual", "fy", "year", "yearly"), "annual")
        .when(f.startswith("Q"), "quarterly")
        .when(f.startswith("FY") | f.startswith("A"), "annual")
        .otherwise(p)
    )


def as_of_date(filing: Column | str, report: Column | str, period: Column | str) -> Column:
    """Filing date, else report date plus 90 days for annual and 45 for other statements."""
    lag = F.when(col(period) == "annual", 90).otherwise(45)
    return F.coalesce(col(filing), F.date_add(col(report), lag))


def option_type(c: Column | str) -> Column:
    t = F.lower(F.trim(col(c)))
    return F.when(t.isin("c", "call", "calls"), "call").when(t.isin("p", "put", "puts"), "put")


def option_type_from_symbol(symbol: Column | str) -> Column:
    """Call or put marker: the fifteenth character of a contract symbol."""
    s = col(symbol)
    mark = F.when(F.length(s) >= 15, F.upper(F.substring(s, 15, 1)))
    return F.when(mark == "C", "call").when(mark == "P", "put")


def fiscal_period(given: Column | str, year: Column | str, quarter: Column | str) -> Column:
    y, q = col(year).cast("string"), col(quarter).cast("string")
    return F.coalesce(blank_to_null(given), F.concat(F.lit("FQ"), q, F.lit("-"), y), F.concat(F.lit("FY"), y))


def safe_ratio(a: Column | str, b: Column | str) -> Column:
    return F.try_divide(col(a).cast("double"), F.nullif(col(b).cast("double"), F.lit(0.0)))


def pct_change(value: Column | str, base: Column | str) -> Column:
    v, b = col(value), col(base)
    return F.when(F.abs(b) > EPS, (v - b) / b)


def bank_round(c: Column | str, places: int = 10) -> Column:
    """Half-even rounding; minus zero becomes zero."""
    return F.bround(col(c), places) + F.lit(0.0)


def first_date_key(columns: Sequence[str], priority: Sequence[str]) -> Column:
    names = [c for c in priority if c in columns]
    return F.coalesce(*[blank_to_null(c) for c in names]) if names else F.lit(None).cast("string")


def title_or_url(title: Column | str, url: Column | str) -> Column:
    return F.coalesce(F.nullif(col(title), F.lit("")), col(url))


def sigmoid(diff: Column | str, steepness: float, cap: float = 1.0) -> Column:
    """1 / (1 + exp(-k * diff)) in [0, cap]; the exponent is held inside +-60."""
    x = F.greatest(F.lit(-60.0), F.least(F.lit(60.0), col(diff) * steepness))
    return F.least(F.lit(cap), F.lit(1.0) / (F.lit(1.0) + F.exp(-x)))


def offset_fraction(c: Column | str) -> Column:
    """Price offset as a fraction; magnitudes above 1 are basis points."""
    x = col(c)
    return F.when(F.abs(x) > 1.0, x / 10_000.0).otherwise(x)


def order_id(run: Column | str, step: Column | str, symbol: Column | str, side: Column | str, qty: Column | str) -> Column:
    """Symbol plus the first 12 hex digits of the SHA-256 of the order's identity."""
    s = col(symbol)
    text = F.concat_ws("|", *[col(c).cast("string") for c in (run, step, symbol, side, qty)])
    return F.concat(s, F.lit("-"), F.substring(F.sha2(text, 256), 1, 12))


def floor_shares(c: Column | str) -> Column:
    x = F.abs(col(c))
    return F.when(x < EPS, 0.0).otherwise(F.floor(x + EPS).cast("double"))


# Fixed value: run timestamps lie within ten years of 2020-01-01.
RUN_EPOCH = 1_577_836_800
RUN_SPAN = 315_360_000


def run_timestamp(identity: Column | str) -> Column:
    """A timestamp derived from the identity's hash, equal on every rerun."""
    n = F.conv(F.substring(F.sha2(col(identity), 256), 1, 12), 16, 10).cast("bigint")
    return F.timestamp_seconds(F.lit(RUN_EPOCH) + n % RUN_SPAN)


def identity_hash(names: Sequence[str]) -> Column:
    """SHA-256 of the row as JSON with sorted field names."""
    return F.sha2(F.to_json(F.struct(*[F.col(n) for n in sorted(names)])), 256)


def json_metric(payload: Column | str, path: str) -> Column:
    """Finite number at a JSON path, else null."""
    return to_float(F.get_json_object(col(payload), path))
