"""Coverage, null and staleness reports, table digests and the health verdict."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapewell.functions.scalars import as_of_date


def coverage(bars: DataFrame, mode: str = "union") -> DataFrame:
    """Expected, observed and missing sessions per symbol for a union, intersection or symbol calendar.

    Counts suffice: no calendar x symbol grid is formed.
    """
    seen = bars.select("symbol", F.col("ts").cast("date").alias("day")).distinct()
    days = seen.groupBy("day").agg(F.count(F.lit(1)).alias("n"))
    symbols = seen.select(F.count_distinct("symbol")).scalar()
    per = seen.groupBy("symbol").agg(F.count(F.lit(1)).alias("observed_count"), F.min("day").alias("first_observed"), F.max("day").alias("last_observed"))
    if mode == "union":
        per = per.withColumn("expected_count", days.select(F.count(F.lit(1))).scalar()).withColumn(
            "missing_count", F.col("expected_count") - F.col("observed_count"))
    elif mode == "intersection":
        per = per.withColumn("expected_count", days.filter(F.col("n") == symbols).select(F.count(F.lit(1))).scalar()).withColumn(
            "missing_count", F.lit(0).cast("bigint"))
    elif mode == "symbol":
        from tapewell.operators.calendars import union_calendar

        cal = union_calendar(seen.select(F.col("day").cast("timestamp").alias("ts")), 86_400).select(F.col("ts").cast("date").alias("d"), "sid")
        a = cal.select(F.col("d").alias("first_observed"), F.col("sid").alias("_a"))
        z = cal.select(F.col("d").alias("last_observed"), F.col("sid").alias("_z"))
        per = per.join(a, "first_observed").join(z, "last_observed").withColumn("expected_count", F.col("_z") - F.col("_a") + 1)
        per = per.withColumn("missing_count", F.col("expected_count") - F.col("observed_count")).drop("_a", "_z")
    else:
        raise ValueError("mode must be union, intersection or symbol")
    return per.withColumn("missing_ratio", F.try_divide("missing_count", "expected_count"))


def null_report(frame: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Null counts per (column, symbol), per column and overall."""
    per = frame.groupBy("symbol").agg(F.count(F.lit(1)).alias("rows"), *[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    long = per.unpivot(["symbol", "rows"], list(columns), "column", "nan_count")
    out = long.rollup("column", "symbol").agg(F.sum("rows").alias("rows"), F.sum("nan_count").alias("nan_count"))
    return out.withColumn("nan_ratio", F.try_divide("nan_count", "rows"))


def valid_row_ratio(frame: DataFrame, columns: Sequence[str]) -> DataFrame:
    ok = F.lit(True)
    for c in columns:
        ok = ok & F.col(c).isNotNull()
    return frame.groupBy("symbol").agg(F.count(F.lit(1)).alias("rows"), F.avg(ok.cast("double")).alias("row_valid_ratio"))


def fundamentals_health(rows: DataFrame, start: str, end: str, stale_days: int = 180) -> DataFrame:
    """Report-date range, last known date and staleness at the end of the window, per symbol."""
    asof = as_of_date("filing_date", "report_date", "period")
    out = rows.withColumn("_asof", asof).groupBy("symbol").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("report_date").between(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("rows_in_window"),
        F.min("report_date").alias("first_report_date"), F.max("report_date").alias("last_report_date"), F.max("_asof").alias("last_as_of_date"),
    )
    out = out.withColumn("stale_days_end", F.datediff(F.lit(end).cast("date"), "last_as_of_date"))
    return out.withColumn("stale_at_end", F.col("stale_days_end") > stale_days)


def domain_coverage(pairs: DataFrame) -> DataFrame:
    """Symbols, first and last date, and mean share of the union dates a symbol has, in percent."""
    seen = pairs.select("symbol", "day").distinct()
    dates = seen.select(F.count_distinct("day")).scalar()
    per = seen.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.min("day").alias("a"), F.max("day").alias("z"))
    return per.agg(
        F.count(F.lit(1)).alias("symbols"), F.min("a").alias("min_date"), F.max("z").alias("max_date"),
        (F.avg(F.col("n") / dates) * 100.0).alias("coverage"),
    )


def row_text(columns: Sequence[str]) -> Column:
    return F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in sorted(columns)])


def digest_parts(df: DataFrame, text: Column, by: Sequence[str] = ()) -> DataFrame:
    """Count, xor and sum of 60-bit row hashes: parts of disjoint sets of rows add up."""
    h = F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), F.bit_xor(h).alias("x"), F.sum(h.cast("decimal(38,0)")).alias("s"))


def combine_digests(parts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, rows, digest) of the union of the parts."""
    whole = parts.groupBy(*by).agg(F.sum("rows").alias("rows"), F.bit_xor("x").alias("_x"), F.sum("s").alias("_s"))
    return whole.withColumn("digest", F.sha2(F.concat_ws("|", *[F.col(c).cast("string") for c in ("rows", "_x", "_s")]), 256)).drop("_x", "_s")


def table_digest(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Order-free content digest: count, xor and sum of 60-bit row hashes, hashed together.

    Every part is a partial aggregate, so nothing is gathered or sorted.
    """
    parts = digest_parts(df, row_text(columns), by)
    return parts.withColumn("digest", F.sha2(F.concat_ws("|", *[F.col(c).cast("string") for c in ("rows", "x", "s")]), 256)).drop("x", "s")


def health_verdict(per_symbol: DataFrame, nulls: DataFrame, max_missing: float | None, max_nan: float | None) -> DataFrame:
    """One row with the failed thresholds: overall missing ratio, worst column null ratio."""
    missing = per_symbol.agg(F.try_divide(F.sum("missing_count"), F.sum("expected_count")).alias("missing_ratio"))
    worst = nulls.filter(F.col("column").isNotNull() & F.col("symbol").isNull()).agg(F.max("nan_ratio"))
    out = missing.withColumn("max_nan_ratio", worst.scalar())

    def fails(c: str, limit: float | None, code: str) -> Column:
        if limit is None:
            return F.lit(None).cast("string")
        return F.when(F.col(c).isNull() | (F.col(c) > limit), F.lit(code))

    bad = F.array_compact(F.array(
        fails("missing_ratio", max_missing, "missing_ratio_exceeded"), fails("max_nan_ratio", max_nan, "nan_ratio_exceeded"),
    ))
    return out.withColumn("failures", F.array_join(bad, ",")).withColumn("passed", F.size(bad) == 0)
