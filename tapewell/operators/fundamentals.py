"""Trailing statement sums, known-at dates and point-in-time attachment to bars."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewell.functions.scalars import as_of_date
from tapewell.operators.keyed import asof_backward, keep_best, ordinal, rolling, running, time_bucket
from tapewell.session import checkpointed

DAY = 86_400
STALE_DAYS = 180


def known_statements(rows: DataFrame, flows: Sequence[str], balances: Sequence[str]) -> DataFrame:
    """One row per (symbol, report_date): when it became known, trailing four-quarter sums of the flow
    fields (annual figures, carried forward, where four quarters are absent) and the balance fields.

    A quarterly statement beats an annual one of the same date.
    """
    keys = ["symbol", "report_date"]
    rows = rows.withColumn("as_of_date", as_of_date("filing_date", "report_date", "period"))
    one = checkpointed(keep_best(rows, [*keys, "period"], ["filing_date"]))
    bucket = time_bucket("report_date", DAY)
    quarters = ordinal(one.filter(F.col("period") == "quarterly").select(*keys, *flows), ["symbol"], ["report_date"], bucket)

    def trailing(f, w):
        return {f"_ttm_{c}": F.when(F.count(c).over(f(-3, 0)) == 4, F.sum(c).over(f(-3, 0))) for c in flows}

    ttm = rolling(quarters, ["symbol"], trailing, back=3).select(*keys, *[f"_ttm_{c}" for c in flows])
    rank = F.when(F.col("period") == "quarterly", 1).otherwise(0)
    annual = F.col("period") == "annual"
    dates = one.groupBy(*keys).agg(
        F.max_by(F.struct("as_of_date", *balances), rank).alias("_last"),
        F.max(F.when(annual, F.struct(*flows))).alias("_annual"),
    ).join(ttm, keys, "left")
    placed = ordinal(dates, ["symbol"], ["report_date"], bucket)
    carried = running(placed, ["symbol"], {"_known": ("last", "_annual")})
    return carried.select(
        *keys, F.col("_last.as_of_date").alias("as_of_date"),
        *[F.coalesce(F.col(f"_ttm_{c}"), F.col(f"_known.{c}")).alias(f"fund_ttm_{c}") for c in flows],
        *[F.col(f"_last.{c}").alias(f"fund_{c}") for c in balances],
    )


def attach_fundamentals(bars: DataFrame, known: DataFrame, ts: str = "ts", step_seconds: int = DAY, stale_days: int = STALE_DAYS) -> DataFrame:
    """Latest known statement at each bar; older than ``stale_days`` is nulled and flagged."""
    values = [c for c in known.columns if c != "symbol"]
    out = asof_backward(bars, known, ["symbol"], ts, "as_of_date", values, step_seconds, right_tie=["report_date"])
    stale = F.coalesce(F.datediff(F.col(ts).cast("date"), F.col("as_of_date").cast("date")) > stale_days, F.lit(False))
    out = out.withColumn("fund_stale", stale)
    cells = {c: F.when(~F.col("fund_stale"), F.col(c)) for c in values if c.startswith("fund_")}
    return out.withColumns(cells).withColumn("fund_row_valid", F.col("as_of_date").isNotNull() & ~F.col("fund_stale"))


STATEMENT_KEYS = ("symbol", "report_period", "period", "fiscal_period")


def combine_statements(income: DataFrame, balance: DataFrame, cash: DataFrame) -> DataFrame:
    """Income, balance and cash-flow rows of one period side by side, prefixed, with the first currency."""
    sides = []
    for prefix, df in (("income", income), ("balance", balance), ("cashflow", cash)):
        keyed = df.withColumns({k: F.coalesce(F.col(k).cast("string"), F.lit("")) for k in STATEMENT_KEYS})
        sides.append(keyed.select(*STATEMENT_KEYS, *[F.col(c).alias(f"{prefix}_{c}") for c in df.columns if c not in STATEMENT_KEYS]))
    out = sides[0].join(sides[1], list(STATEMENT_KEYS), "full").join(sides[2], list(STATEMENT_KEYS), "full")
    money = [c for c in ("income_currency", "balance_currency", "cashflow_currency") if c in out.columns]
    return out.withColumn("currency", F.coalesce(*money)) if money else out
