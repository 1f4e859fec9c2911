"""Several vendors into one canonical table, filing restatements, and price sanity."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapewell.operators.keyed import keep_best, ordinal, rolling, time_bucket
from tapewell.session import checkpointed

MAX_HIGH_LOW = 50.0
SPLITS = (2.0, 3.0, 4.0, 5.0)
SANITY = {"min_abs_return": 0.45, "max_return_sigma": 24.0, "median_jump": 3.6}


def vendor_rank(priority: Sequence[str], vendor: str = "vendor") -> Column:
    return F.array_position(F.array(*[F.lit(v) for v in priority]), F.col(vendor))


def pick_vendor(rows: DataFrame, priority: Sequence[str], keys: Sequence[str] = ("symbol", "ts")) -> DataFrame:
    """First vendor in priority order per key, with provenance columns."""
    ranked = rows.withColumn("_rank", vendor_rank(priority)).filter(F.col("_rank") > 0)
    best = keep_best(ranked, keys, ["_rank"], first=True)
    primary = F.col("_rank") == 1
    return best.withColumns({
        "method": F.when(primary, "primary").otherwise("fallback"),
        "primary_vendor": F.lit(priority[0]),
        "fallback_vendor": F.when(~primary, F.col("vendor")),
    }).drop("_rank")


def reconciliation_metrics(rows: DataFrame, priority: Sequence[str], keys: Sequence[str] = ("symbol", "ts")) -> DataFrame:
    """One row: missing-primary and fallback share, mean close (bp) and volume (%) gap of the top two vendors.

    The top two are found by one conditional aggregate per vendor, so no candidate list is built.
    """
    picks = [
        F.max(F.when(F.col("vendor") == v, F.struct("close", "volume"))).alias(f"_v{i}")
        for i, v in enumerate(priority)
    ]
    wide = rows.groupBy(*keys).agg(*picks)
    present = F.array_compact(F.array(*[F.col(f"_v{i}") for i in range(len(priority))]))
    wide = wide.select((F.col("_v0").isNull()).alias("_miss"), present.alias("_c")).filter(F.size("_c") > 0)
    top, second = F.col("_c")[0], F.get("_c", F.lit(1))
    gap = lambda field, scale: F.when(
        (top[field] != 0) & (second[field] != 0), F.abs(top[field] - second[field]) / top[field] * scale)
    return wide.agg(
        F.count(F.lit(1)).alias("total_records"),
        F.sum(F.col("_miss").cast("bigint")).alias("fallback_count"),
        F.avg(F.col("_miss").cast("double")).alias("percent_missing_primary"),
        F.avg(gap("close", 10_000.0)).alias("close_diff_bp"), F.count(gap("close", 1.0)).alias("close_diff_samples"),
        F.avg(gap("volume", 100.0)).alias("volume_diff_pct"), F.count(gap("volume", 1.0)).alias("volume_diff_samples"),
    )


def vendor_usage(selected: DataFrame) -> DataFrame:
    return selected.groupBy("vendor").agg(F.count(F.lit(1)).alias("records"))


def pick_vendor_rows(rows: DataFrame, priority: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """All rows of the first vendor in priority order that has the key, with provenance columns.

    The chosen rank per key is one aggregate that goes back to the rows by a join, so a key of any size stays split.
    """
    ranked = rows.withColumn("_rank", vendor_rank(priority)).filter(F.col("_rank") > 0)
    chosen = ranked.groupBy(*keys).agg(F.min("_rank").alias("_rank"))
    primary = F.col("_rank") == 1
    return ranked.join(chosen, [*keys, "_rank"], "left_semi").withColumns({
        "method": F.when(primary, "primary").otherwise("fallback"),
        "primary_vendor": F.lit(priority[0]),
        "fallback_vendor": F.when(~primary, F.col("vendor")),
    }).drop("_rank")


def vendor_coverage(rows: DataFrame, priority: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """One row: keys, keys without the primary vendor and their share, records chosen and those from a fallback."""
    ranked = rows.withColumn("_rank", vendor_rank(priority)).filter(F.col("_rank") > 0)
    per = ranked.groupBy(*keys, "_rank").agg(F.count(F.lit(1)).alias("_n")).groupBy(*keys).agg(F.min(F.struct("_rank", "_n")).alias("_c"))
    missing = (F.col("_c._rank") > 1).cast("bigint")
    out = per.agg(
        F.count(F.lit(1)).alias("keys"), F.coalesce(F.sum(missing), F.lit(0)).alias("missing_primary"),
        F.coalesce(F.sum("_c._n"), F.lit(0)).alias("records"), F.coalesce(F.sum(missing * F.col("_c._n")), F.lit(0)).alias("fallback_records"))
    return out.withColumn("percent_missing_primary", F.coalesce(F.try_divide(F.col("missing_primary").cast("double"), F.col("keys")), F.lit(0.0)))


def latest_filings(rows: DataFrame, keys: Sequence[str], priority: Sequence[str] | None = None) -> DataFrame:
    """The first vendor that has the key, then its last filing by (filing_date, filing_id).

    ``method`` is ``restatement`` if that vendor has earlier filings of the key, else ``record_vendor`` for the first
    vendor and ``fallback`` for the others; without ``priority`` all rows are the vendor of record's.
    """
    if priority is not None:
        rows = pick_vendor_rows(rows, priority, keys).drop("primary_vendor", "fallback_vendor")
    best = keep_best(rows, keys, ["filing_date", "filing_id"])
    n = rows.groupBy(*keys).agg(F.count(F.nullif("filing_id", F.lit(""))).alias("_n"))
    out = best.join(n, list(keys))
    older = F.col("_n") - F.when(F.coalesce(F.col("filing_id"), F.lit("")) != "", 1).otherwise(0)
    base = F.lit("record_vendor") if priority is None else F.when(F.col("method") == "primary", "record_vendor").otherwise("fallback")
    return out.withColumn("superseded", older).withColumn("method", F.when(older > 0, "restatement").otherwise(base)).drop("_n")


def superseded_filings(rows: DataFrame, keys: Sequence[str], priority: Sequence[str] | None = None) -> DataFrame:
    """The filings of the chosen vendor that a later one of its own replaced, one row each."""
    if priority is not None:
        rows = pick_vendor_rows(rows, priority, keys)
    ids = [*keys, "filing_date", "filing_id"]
    best = keep_best(rows, keys, ["filing_date", "filing_id"]).select(*ids)
    return rows.join(best, ids, "left_anti").filter(F.coalesce(F.col("filing_id"), F.lit("")) != "").select(*ids)


def ohlc_invalid(max_ratio: float = MAX_HIGH_LOW) -> Column:
    """A price absent or not positive, a range that does not hold open and close, or high / low too wide."""
    o, h, lo, c = (F.col(x) for x in ("open", "high", "low", "close"))
    absent = o.isNull() | h.isNull() | lo.isNull() | c.isNull()
    sign = (F.least(o, h, lo, c) <= 0)
    shape = (h < F.greatest(o, c, lo)) | (lo > F.least(o, c))
    wide = F.try_divide(h, lo) > max_ratio
    return absent | F.coalesce(sign | shape | wide, F.lit(False))


def split_like(ratio: Column) -> Column:
    """Within 5 % of a 2, 3, 4 or 5 for one split or its reverse."""
    near = F.lit(False)
    for m in SPLITS:
        near = near | (F.abs(ratio - m) <= 0.05 * m) | (F.abs(ratio - 1.0 / m) <= 0.05 / m)
    return near


def price_sanity(bars: DataFrame, step_seconds: int, cfg: Mapping[str, float] = SANITY, max_ratio: float = MAX_HIGH_LOW) -> DataFrame:
    """Bars with flags ``ohlc_invalid``, ``split_like``, ``return_outlier``, ``median_jump`` and the
    20-row ``mean_close``.

    The deviation is taken over the last 60 returns that are no splits, the mean over the last 20
    positive closes, so each is computed on its own row numbering.
    """
    bucket = time_bucket("ts", step_seconds)
    keys, order = ["symbol"], ["ts"]
    placed = ordinal(bars, keys, order, bucket)

    def ratio(f, w):
        prev = F.lag("close").over(w)
        ok = (F.col("close") > 0) & (prev > 0)
        return {"_ratio": F.when(ok, F.col("close") / prev)}

    base = rolling(placed, keys, ratio, back=1).drop("_rn")
    base = base.withColumn("split_like", F.coalesce(split_like(F.col("_ratio")), F.lit(False)))
    base = checkpointed(base.withColumn("_lr", F.when(~F.col("split_like"), F.ln("_ratio"))))

    plain = ordinal(base.filter(F.col("_lr").isNotNull()).select(*keys, "ts", "_lr"), keys, order, bucket)
    plain = rolling(plain, keys, lambda f, w: {"_sd": F.stddev_pop("_lr").over(f(-59, 0))}, back=59)
    limit = F.greatest(F.lit(cfg["min_abs_return"]), cfg["max_return_sigma"] * F.col("_sd"))
    outlier = plain.select(*keys, "ts", (F.abs("_lr") > limit).alias("return_outlier"))

    positive = ordinal(base.filter(F.col("close") > 0).select(*keys, "ts", "close"), keys, order, bucket)
    positive = rolling(positive, keys, lambda f, w: {"mean_close": F.avg("close").over(f(-19, 0))}, back=19)
    jump = positive.select(
        *keys, "ts", "mean_close", (F.abs(F.col("close") / F.col("mean_close") - 1.0) > cfg["median_jump"]).alias("median_jump"),
    )
    out = base.join(outlier, [*keys, "ts"], "left").join(jump, [*keys, "ts"], "left")
    return out.withColumn("ohlc_invalid", ohlc_invalid(max_ratio)).fillna(False, ["return_outlier", "median_jump"]).drop("_ratio", "_lr")


ANOMALIES = ("ohlc_invalid", "return_outlier", "median_jump")


def sanity_report(flagged: DataFrame) -> DataFrame:
    """Count and first/last time per symbol and per (type, symbol); type ``all`` is the symbol level."""
    kinds = F.array(*[F.when(F.col(k), F.lit(k)) for k in (*ANOMALIES, "split_like")])
    long = flagged.select("symbol", "ts", F.explode(F.array_compact(kinds)).alias("type"))
    violations = long.groupingSets([["type", "symbol"], ["symbol"]], "type", "symbol").agg(
        F.count(F.when(F.col("type") != "split_like", 1)).alias("violations"),
        F.count(F.lit(1)).alias("n"), F.min("ts").alias("min_ts"), F.max("ts").alias("max_ts"), F.grouping("type").alias("_g"),
    )
    return violations.withColumn("type", F.when(F.col("_g") == 1, "all").otherwise(F.col("type"))).drop("_g")


def apply_action(flagged: DataFrame, action: str) -> DataFrame:
    """report keeps all rows, drop removes flagged ones, clip sets their prices to the mean, fail raises."""
    bad = F.col("ohlc_invalid") | F.col("return_outlier") | F.col("median_jump")
    if action == "report":
        return flagged
    if action == "drop":
        return flagged.filter(~bad)
    if action == "clip":
        return flagged.withColumns({
            c: F.when(bad & F.col("mean_close").isNotNull(), F.col("mean_close")).otherwise(F.col(c))
            for c in ("open", "high", "low", "close")
        })
    if action == "fail":
        message = F.concat(F.lit("price sanity failed for "), F.col("symbol"), F.lit(" at "), F.col("ts").cast("string"))
        return flagged.withColumn("close", F.when(bad, F.raise_error(message)).otherwise(F.col("close")))
    raise ValueError("action must be report, drop, clip or fail")
