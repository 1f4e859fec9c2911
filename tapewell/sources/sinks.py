"""Partitioned, deduplicating table writers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from tapewell.functions.scalars import first_date_key, title_or_url
from tapewell.operators.keyed import keep_best
from tapewell.session import checkpointed
from tapewell.sources import snapshots


def read_if_exists(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at ``path`` with the columns of all its files, so that partitions written before a column came keep it out
    and those with it keep its values; None if there is none."""
    try:
        return spark.read.option("mergeSchema", "true").parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return None
        raise


def write_sorted(df: DataFrame, path: str, partitions: Sequence[str], order: Sequence[str], mode: str = "overwrite") -> None:
    """Write by partition value.  The rebalance hint lets adaptive execution split a partition value
    that holds very many rows over several files and join small ones."""
    out = df.hint("rebalance", *partitions) if partitions else df
    w = out.sortWithinPartitions(*partitions, *order).write.mode(mode).option("compression", "zstd")
    if partitions:
        w = w.option("partitionOverwriteMode", "dynamic").partitionBy(*partitions)
    w.parquet(path)


def merge_latest(existing: DataFrame | None, incoming: DataFrame, keys: Sequence[str], seq: str | None = None) -> DataFrame:
    """Existing and incoming rows, the incoming (then the highest ``seq``) winning per key.

    Columns missing on either side become null.
    """
    order = ["_new"] + ([seq] if seq else [])
    rows = incoming.withColumn("_new", F.lit(1))
    if existing is not None:
        rows = existing.withColumn("_new", F.lit(0)).unionByName(rows, allowMissingColumns=True)
    return keep_best(rows, keys, order).drop("_new")


def upsert_partitioned(
    incoming: DataFrame, path: str, keys: Sequence[str], partitions: Sequence[str], order: Sequence[str], seq: str | None = None,
) -> None:
    """Merge into the touched partitions only, then replace exactly those.

    The merged rows are written to the shared folder first, because the target is both read and
    replaced.
    """
    spark = incoming.sparkSession
    existing = read_if_exists(spark, path)
    if existing is not None:
        touched = incoming.select(*partitions).distinct()
        existing = existing.join(touched, list(partitions), "left_semi")
    merged = checkpointed(merge_latest(existing, incoming, keys, seq))
    write_sorted(merged, path, partitions, order)


def write_bars(bars: DataFrame, path: str, interval: str = "daily") -> None:
    """Bars by symbol and year (daily) or symbol, year and month (intraday)."""
    parts = {"year": F.year("ts")} if interval == "daily" else {"year": F.year("ts"), "month": F.month("ts")}
    upsert_partitioned(bars.withColumns(parts), path, ["symbol", "ts", "vendor", *parts], ["symbol", *parts], ["ts", "vendor"])


def write_daily(rows: DataFrame, path: str, symbol: str, day: str, order: Sequence[str]) -> None:
    parts = {"year": F.year(day), "month": F.month(day), "day_of_month": F.dayofmonth(day)}
    write_sorted(rows.withColumns(parts), path, [symbol, *parts], order)


def reject_conflicts(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Drop equal copies of a key; a key with two different rows is an error naming it."""
    rest = [c for c in rows.columns if c not in keys]
    text = F.to_json(F.struct(*rest))
    one = rows.withColumn("_h", F.sha2(text, 256)).groupBy(*keys).agg(
        F.first(F.struct(*rest)).alias("_r"), F.min("_h").alias("_a"), F.max("_h").alias("_z"),
    )
    message = F.concat(F.lit("conflicting record for "), F.concat_ws("|", *[F.col(k).cast("string") for k in keys]))
    checked = one.withColumn("_ok", F.when(F.col("_a") != F.col("_z"), F.raise_error(message)).otherwise(F.lit(True)))
    return checked.filter("_ok").select(*keys, "_r.*").select(*rows.columns)


# Storage policies of the vendor domains.
POLICIES: dict[str, dict] = {
    "company_facts": {"policy": "snapshot_single_csv", "dates": (), "keys": ("ticker",)},
    "financial_metrics": {"policy": "snapshot_table_csv", "dates": ("report_period", "as_of_date"), "keys": ("ticker",)},
    "financial_metrics_snapshot": {"policy": "snapshot_table_csv", "dates": ("report_period", "as_of_date"), "keys": ("ticker",)},
    "financial_statements": {"policy": "timeseries_csv_unsharded", "dates": ("report_date",), "keys": ("ticker", "report_date", "statement_type")},
    "institutional_ownership": {"policy": "timeseries_csv_unsharded", "dates": ("report_period",), "keys": ("ticker", "report_period", "investor")},
    "news": {"policy": "timeseries_csv_unsharded", "dates": ("published_at", "date"), "keys": ("title_or_url",)},
    "insider_trades": {
        "policy": "timeseries_csv_yearly", "dates": ("filing_date",),
        "keys": ("filing_date", "name", "transaction_date", "transaction_value", "transaction_shares", "security_title"),
    },
}


def apply_policy(existing: DataFrame | None, incoming: DataFrame, domain: str, seq: str) -> DataFrame:
    """Union by name, drop rows without a date key, keep the last row per the domain's key."""
    rule = POLICIES[domain]
    rows = incoming.withColumn("_new", F.lit(1))
    if existing is not None:
        rows = existing.withColumn("_new", F.lit(0)).unionByName(rows, allowMissingColumns=True)
    keys = ["ticker"]
    if rule["dates"]:
        rows = rows.withColumn("date_key", first_date_key(rows.columns, rule["dates"])).filter(F.col("date_key").isNotNull())
        keys.append("date_key")
    if domain == "news":
        rows = rows.withColumn("title_or_url", title_or_url("title", "url"))
    for k in rule["keys"]:
        if k not in keys:
            keys.append(k)
            if k not in rows.columns:
                rows = rows.withColumn(k, F.lit(""))
    # a key column that only one side has reads as empty text on the other
    rows = rows.fillna("", [k for k in keys if dict(rows.dtypes)[k] == "string"])
    return keep_best(rows, keys, ["_new", seq]).drop("_new")


def write_policy(incoming: DataFrame, path: str, domain: str, seq: str) -> None:
    """Store a vendor domain by its policy: yearly domains replace only the years they touch, the others only the ticker
    buckets they touch, behind a snapshot."""
    rule = POLICIES[domain]
    spark = incoming.sparkSession
    if rule["policy"] == "timeseries_csv_yearly":
        dated = incoming.withColumn("year", F.substring(first_date_key(incoming.columns, rule["dates"]), 1, 4).try_cast("int"))
        existing = read_if_exists(spark, path)
        if existing is not None:
            existing = existing.join(dated.select("year").distinct(), "year", "left_semi")
        merged = checkpointed(apply_policy(existing, dated, domain, seq))
        write_sorted(merged, path, ["year"], ["ticker", "date_key"])
        return
    order = ["ticker"] + (["date_key"] if rule["dates"] else [])
    snapshots.upsert(incoming, path, "ticker", lambda old, new: apply_policy(old, new, domain, seq), order)


def read_policy(spark: SparkSession, path: str, domain: str) -> DataFrame | None:
    """A vendor domain as ``write_policy`` stored it."""
    return read_if_exists(spark, path) if POLICIES[domain]["policy"] == "timeseries_csv_yearly" else snapshots.read(spark, path)


def migrate_layout(old: DataFrame, path: str, domain: str, seq: str) -> DataFrame:
    """Rewrite per-day vendor files into the policy layout; one row of read / written / skipped counts."""
    keyed = first_date_key(old.columns, POLICIES[domain]["dates"])
    write_policy(old, path, domain, seq)
    written = read_policy(old.sparkSession, path, domain).select(F.count(F.lit(1)).alias("rows_written"))
    counts = old.agg(F.count(F.lit(1)).alias("rows_read"), F.count_if(keyed.isNull()).alias("rows_skipped"))
    return counts.withColumn("rows_written", written.scalar())


def run_manifest(written: DataFrame, usage: Sequence[str], run_id: Column, day: str) -> DataFrame:
    """Record counts, date range and vendor usage of a run, one row."""
    counts = [F.count_if(F.col("vendor") == v).alias(f"records_{v}") for v in usage]
    return written.agg(
        F.count(F.lit(1)).alias("records"), F.min(day).alias("start_date"), F.max(day).alias("end_date"), *counts,
    ).withColumn("run_id", run_id)
