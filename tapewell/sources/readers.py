"""Readers of vendor files and canonical tables: alias resolution, typing and pruning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapewell.functions import scalars as sc
from tapewell.operators.keyed import keep_best
from tapewell.sources.archives import zip_members

# Column names vendors use for a bar.
BAR_ALIASES = {
    "symbol": ("symbol", "ticker"), "ts": ("timestamp", "t", "date"), "open": ("open", "o"), "high": ("high", "h"),
    "low": ("low", "l"), "close": ("close", "c"), "volume": ("volume", "v"),
}


def _files(spark: SparkSession, path: str, kind: str, columns: Sequence[str] = ()) -> DataFrame:
    """Raw rows; the columns of zip members have to be named."""
    if kind == "csv":
        return spark.read.option("header", True).csv(path)
    if kind == "parquet":
        return spark.read.parquet(path)
    if kind == "json":
        return spark.read.json(path, primitivesAsString=True)
    if kind == "json_document":
        return spark.read.json(path, primitivesAsString=True, multiLine=True)
    if kind == "zip":
        return zip_members(spark, path, columns)
    raise ValueError("kind must be csv, parquet, json, json_document or zip")


def resolve_bars(raw: DataFrame) -> DataFrame:
    """Vendor columns to symbol, ts, OHLC and volume (0 where absent)."""
    cols = raw.columns
    prices = {c: sc.to_float(sc.first_present(cols, BAR_ALIASES[c])) for c in ("open", "high", "low", "close")}
    return raw.select(
        sc.normalize_symbol(sc.first_present(cols, BAR_ALIASES["symbol"])).alias("symbol"),
        sc.coerce_timestamp(sc.first_present(cols, BAR_ALIASES["ts"])).alias("ts"),
        *[c.alias(n) for n, c in prices.items()],
        F.coalesce(sc.to_float(sc.first_present(cols, BAR_ALIASES["volume"])), F.lit(0.0)).alias("volume"),
    )


def flat_file_bars(spark: SparkSession, path: str, kind: str = "csv") -> DataFrame:
    """Flat-file equity bars; gzip is handled by the reader."""
    return resolve_bars(_files(spark, path, kind, [c for names in BAR_ALIASES.values() for c in names]))


# Column names vendors use for an open-interest row.
INTEREST_ALIASES = {"option_symbol": ("option_symbol", "ticker", "contract"), "ts": ("timestamp", "t", "date"), "open_interest": ("open_interest", "oi")}


def option_flat_files(spark: SparkSession, path: str, kind: str = "json") -> DataFrame:
    raw = _files(spark, path, kind, [c for names in INTEREST_ALIASES.values() for c in names])
    cols = raw.columns
    return raw.select(
        sc.normalize_symbol(sc.first_present(cols, INTEREST_ALIASES["option_symbol"])).alias("option_symbol"),
        sc.coerce_timestamp(sc.first_present(cols, INTEREST_ALIASES["ts"])).alias("ts"),
        sc.to_float(sc.first_present(cols, INTEREST_ALIASES["open_interest"])).alias("open_interest"),
    )


def fundamentals_json(
    spark: SparkSession, path: str, symbols: Sequence[str] = (), types: Sequence[str] = (), start: str | None = None, end: str | None = None,
) -> DataFrame:
    """Statements from ``{results: [...]}`` documents or plain records, filtered while scanning."""
    raw = spark.read.json(path)
    if "results" in raw.columns:
        raw = raw.select(F.explode("results").alias("r")).select("r.*")
    out = raw
    if symbols:
        out = out.filter(F.col("symbol").isin([s.upper() for s in symbols]))
    if types:
        out = out.filter(F.col("statement_type").isin(list(types)))
    if start:
        out = out.filter(F.col("report_date") >= start)
    if end:
        out = out.filter(F.col("report_date") <= end)
    return out


def nested_metric(schema: T.StructType, field: str) -> Column:
    """A metric at the top level, under ``metrics`` or in a section of ``financials`` (bare or ``.value``)."""
    options: list[Column] = []
    kinds = {f.name: f.dataType for f in schema.fields}
    if field in kinds:
        options.append(F.col(field).try_cast("double"))
    if isinstance(kinds.get("metrics"), T.StructType) and field in kinds["metrics"].names:
        options.append(F.col(f"metrics.{field}").try_cast("double"))
    if isinstance(kinds.get("financials"), T.StructType):
        for section in kinds["financials"].fields:
            if isinstance(section.dataType, T.StructType) and field in section.dataType.names:
                ref, inner = f"financials.{section.name}.{field}", section.dataType[field].dataType
                options.append(F.col(f"{ref}.value" if isinstance(inner, T.StructType) else ref).try_cast("double"))
    return F.coalesce(*options) if options else F.lit(None).cast("double")


def canonical_bars(spark: SparkSession, path: str, symbols: Sequence[str], start: str, end: str) -> DataFrame:
    """Bars of some symbols in a date range; partition columns prune the folders read."""
    df = spark.read.parquet(path)
    return df.filter(
        F.col("symbol").isin(list(symbols)) & F.col("year").between(int(start[:4]), int(end[:4]))
        & (F.col("ts") >= F.lit(start).cast("timestamp")) & (F.col("ts") < F.date_add(F.lit(end).cast("date"), 1).cast("timestamp"))
    )


def with_lookback(df: DataFrame, day: str, start: str, end: str, days: int) -> DataFrame:
    low = F.date_sub(F.lit(start).cast("date"), days)
    return df.filter(F.col(day).between(low, F.lit(end).cast("date")))


def canonical_fundamentals(rows: DataFrame, start: str, end: str, lookback_days: int = 400) -> DataFrame:
    """Look back 400 days, prefer whole-statement rows where a symbol has any, last filing per period."""
    out = with_lookback(rows, "report_date", start, end, lookback_days)
    if "statement_type" in rows.columns:
        whole = out.filter(F.col("statement_type") == "all").select("symbol").distinct().withColumn("_all", F.lit(True))
        out = out.join(whole, "symbol", "left").filter(F.col("_all").isNull() | (F.col("statement_type") == "all")).drop("_all")
    order = ["filing_date", *[c for c in ("filing_id",) if c in rows.columns]]
    return keep_best(out, ["symbol", "report_date", "period"], order)


def canonical_insiders(rows: DataFrame, start: str, end: str, lookback_days: int = 820) -> DataFrame:
    return with_lookback(rows, "filing_date", start, end, lookback_days)


def canonical_option_reference(rows: DataFrame, underlying: str) -> DataFrame:
    """Contracts of one underlying, upper-cased, the row with the last expiration per contract."""
    up = rows.withColumn("option_symbol", F.upper("option_symbol")).filter(F.upper("underlying") == underlying.upper())
    return keep_best(up, ["option_symbol"], ["expiration_date"])


def options_surface(rows: DataFrame, columns: Sequence[str], flags: Sequence[str], seq: str) -> DataFrame:
    """Last row per symbol and date; absent values null, absent flags false."""
    out = keep_best(rows, ["symbol", "date"], [seq])
    have = set(out.columns)
    flag_set = set(flags)
    cells = []
    for c in columns:
        if c in flag_set:
            cells.append((F.coalesce(F.col(f"`{c}`"), F.lit(False)) if c in have else F.lit(False)).alias(c))
        else:
            cells.append((F.col(f"`{c}`") if c in have else F.lit(None).cast("double")).alias(c))
    return out.select("symbol", "date", *cells)


def bulk_bars(raw: DataFrame, index: str) -> tuple[DataFrame, DataFrame]:
    """Bulk payload rows: the first valid row per (symbol, ts), and the counts kept and dropped."""
    cols = raw.columns
    rows = raw.select(
        F.col(index).alias("_i"), sc.normalize_symbol(sc.first_present(cols, BAR_ALIASES["symbol"])).alias("symbol"),
        sc.coerce_timestamp(sc.first_present(cols, BAR_ALIASES["ts"])).alias("ts"),
        *[sc.to_float(sc.first_present(cols, BAR_ALIASES[c])).alias(c) for c in ("open", "high", "low", "close", "volume")],
    )
    ok = F.col("symbol").isNotNull() & F.col("ts").isNotNull()
    for c in ("open", "high", "low", "close"):
        ok = ok & F.col(c).isNotNull()
    counts = rows.agg(F.count_if(ok).alias("valid"), F.count_if(~ok).alias("invalid"))
    return keep_best(rows.filter(ok), ["symbol", "ts"], ["_i"], first=True).drop("_i"), counts


def list_payload(payloads: DataFrame, key: str, item: str, vendor: str) -> DataFrame:
    """Explode the list under ``key`` (or its dashed form) of JSON payloads; symbol = ticker or symbol."""
    dashed = key.replace("_", "-")
    text = F.coalesce(F.get_json_object("payload", f"$.{key}"), F.get_json_object("payload", f"$['{dashed}']"))
    rows = payloads.select(F.col("symbol").alias("_asked"), F.explode(F.from_json(text, f"array<struct<{item}>>")).alias("r")).select("_asked", "r.*")
    named = [F.col(c) for c in ("ticker", "symbol") if c in rows.columns]
    return rows.withColumn("symbol", F.upper(F.coalesce(*named, F.col("_asked")))).withColumn("source_vendor", F.lit(vendor)).drop("_asked")


# Where a document of an experiment lies: its folder, then the kind of document.
EXPERIMENT_PATH = r"(?:[^/=]+=)?([^/=]+)/(?:[^/=]+=)?(spec|evaluation|logs)/[^/]+$"


def _documents(files: DataFrame) -> DataFrame:
    """(experiment_id, kind, file, payload, doc) of (file, payload) rows; ``doc`` is a VARIANT, null where the file is no JSON."""
    return files.select(F.regexp_extract("file", EXPERIMENT_PATH, 1).alias("experiment_id"), F.regexp_extract("file", EXPERIMENT_PATH, 2).alias("kind"),
                        "file", "payload", F.try_parse_json("payload").alias("doc"))


def json_documents(spark: SparkSession, path: str) -> DataFrame:
    """Every document below ``path``, one file each, whole and parsed."""
    raw = spark.read.text(path, wholetext=True, recursiveFileLookup=True)
    return _documents(raw.select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("payload")))


def pack_documents(documents: DataFrame, path: str) -> None:
    """Writes ``documents`` (file, payload) as a packed registry: many documents to a file, each with the name of the file
    it stands for, so that a registry of any number of experiments takes as many files as tasks."""
    documents.select("file", "payload").write.parquet(path)


def packed_documents(spark: SparkSession, path: str) -> DataFrame:
    """Every document of a packed registry, whole and parsed."""
    return _documents(spark.read.schema("file string, payload string").parquet(path))


def variant_metric(doc: str, metric: str) -> Column:
    """A finite number at the path, below ``metrics`` or under the dotted name as one key; else null."""
    paths = (f"$.{metric}", f"$.metrics.{metric}", f'$["{metric}"]')
    v = F.coalesce(*[F.try_variant_get(doc, p, "double") for p in paths])
    return F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v)


def experiment_summaries(spark: SparkSession, path: str, metrics: Sequence[str], spec: Sequence[str] = (), *, packed: bool = False) -> tuple[DataFrame, DataFrame]:
    """One row per experiment with a metrics document, and the files that are no JSON; ``packed``: of a packed registry.

    Metrics come from the evaluation document, ``spec`` fields and ``recorded_at`` from the other two.  A broken or absent
    document leaves its fields null.
    """
    docs = (packed_documents if packed else json_documents)(spark, path).filter(F.col("experiment_id") != "")

    def of(kind: str, value: Column) -> Column:
        return F.max(F.when(F.col("kind") == kind, value))

    rows = docs.groupBy("experiment_id").agg(
        F.bool_or(F.col("kind") == "evaluation").alias("_kept"), of("logs", F.try_variant_get("doc", "$.recorded_at", "string")).alias("recorded_at"),
        *[of("spec", F.try_variant_get("doc", f"$.{c}", "string")).alias(c) for c in spec],
        *[of("evaluation", variant_metric("doc", m)).alias(m.replace(".", "_")) for m in metrics])
    return rows.filter("_kept").drop("_kept"), docs.filter("doc is null").select("experiment_id", "kind", "file", "payload")


def json_lines(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Fields of the objects of a log, one a line, and the lines that are none; blank lines are neither."""
    lines = spark.read.text(path).select(F.trim("value").alias("line")).filter("line <> ''").withColumn("doc", F.try_parse_json("line"))
    good = F.col("doc").isNotNull() & F.col("line").startswith("{")
    fields = [F.try_variant_get("doc", f"$.{f.name}", f.dataType.simpleString()).alias(f.name) for f in T._parse_datatype_string(schema).fields]
    return lines.filter(good).select(*fields), lines.filter(~good).select("line")


def task_ledger(rows: DataFrame, *, status: str | None = None, contains: str | None = None, tail: int | None = None) -> DataFrame:
    out = rows
    if status:
        out = out.filter(F.col("status") == status)
    if contains:
        out = out.filter(F.col("message").contains(contains))
    return out.orderBy(F.desc("ts"), F.desc("id")).limit(tail) if tail else out
