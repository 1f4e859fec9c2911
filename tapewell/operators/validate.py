"""Schema validation with per-row errors, completeness and screening predicates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapewell.functions.scalars import blank_to_null
from tapewell.schemas import Domain

_CASTS = {"timestamp": "timestamp", "date": "date", "number": "double"}


def _typed(field, columns) -> Column:
    if field.name not in columns:
        return F.lit(None).cast(_CASTS.get(field.kind, "string"))
    c = F.col(f"_raw.{field.name}")
    return c.try_cast(_CASTS[field.kind]) if field.kind in _CASTS else c.cast("string")


def _rules(field, dtypes: Mapping[str, str]) -> list[tuple[Column, str]]:
    """Ordered (broken when, code) rules of one field."""
    name = field.name
    if name not in dtypes:
        return [(F.lit(True), f"missing:{name}")] if field.required else []
    raw, val = F.col(f"_raw.{name}"), F.col(name)
    rules = [(blank_to_null(raw).isNull(), f"missing:{name}")]
    if field.kind == "number" and dtypes[name] == "boolean":
        return [*rules, (F.lit(True), f"type:{name}")]
    if field.kind in _CASTS:
        rules.append((val.isNull(), f"type:{name}"))
    if field.constraint:
        rules.append((F.isnan(val) | (F.abs(val) == float("inf")), f"finite:{name}"))
    if field.constraint == "positive":
        rules.append((val <= 0, f"positive:{name}"))
    if field.constraint == "non_negative":
        rules.append((val < 0, f"non_negative:{name}"))
    return rules


def validate(records: DataFrame, domain: Domain, vendor: str | Column, index: str, *, allow_extra: bool = False) -> DataFrame:
    """Typed records plus ``error``: the first broken rule, or null.

    Among rows that pass, the lowest ``index`` of a key is kept and the others are duplicates.  The
    duplicate test joins on (key, index), so a key with very many copies stays spread out.
    """
    dtypes = dict(records.dtypes)
    expected = {f.name for f in domain.fields}
    extra = sorted(set(records.columns) - expected - {index})
    raw = records.select(F.col(index).alias("_index"), F.struct(*[c for c in records.columns if c != index]).alias("_raw"))
    typed = raw.withColumns({f.name: _typed(f, dtypes) for f in domain.fields})
    rules: list[tuple[Column, str]] = []
    if extra and not allow_extra:
        rules.append((F.lit(True), f"unexpected:{','.join(extra)}"))
    for f in domain.fields:
        rules.extend(_rules(f, dtypes))
    want = F.lit(vendor) if isinstance(vendor, str) else vendor
    if "source_vendor" in dtypes:
        rules.append((F.col("source_vendor") != want, "vendor:source_vendor"))
    error = F.coalesce(*[F.when(cond, F.lit(code)) for cond, code in rules])
    checked = typed.withColumn("error", error).drop("_raw")
    key = list(domain.key)
    first = checked.filter(F.col("error").isNull()).groupBy(*key).agg(F.min("_index").alias("_index")).withColumn("_kept", F.lit(True))
    out = checked.join(first, [*key, "_index"], "left")
    dup = F.col("error").isNull() & F.col("_kept").isNull()
    return out.withColumn("error", F.when(dup, "duplicate").otherwise(F.col("error"))).drop("_kept").withColumnRenamed("_index", index)


def validation_summary(validated: DataFrame) -> DataFrame:
    """Manifest counts; the status is passed only without any error."""
    bad = F.count("error")
    return validated.agg(
        F.count(F.lit(1)).alias("total_records"), (F.count(F.lit(1)) - bad).alias("valid_records"), bad.alias("invalid_records"),
    ).withColumn("status", F.when(F.col("invalid_records") == 0, "passed").otherwise("failed"))


def complete(required: Sequence[str]) -> Column:
    """All fields present as numbers."""
    ok = F.lit(True)
    for c in required:
        ok = ok & F.col(c).try_cast("double").isNotNull()
    return ok


_OPS = {
    "eq": lambda c, v: c == v, "ne": lambda c, v: c != v, "gt": lambda c, v: c > v, "gte": lambda c, v: c >= v,
    "lt": lambda c, v: c < v, "lte": lambda c, v: c <= v,
}


def _value(text: str):
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            continue
    return text


def screen(rows: DataFrame, filters: Sequence[str], limit: int | None = None, order: Sequence[str] = ()) -> DataFrame:
    """Rows meeting every ``field:op:value`` filter; ``limit`` is the screener's own page size."""
    out = rows
    for token in filters:
        field, op, value = token.split(":", 2)
        if op == "in":
            out = out.filter(F.col(field).isin([_value(v) for v in value.split(",")]))
        elif op in _OPS:
            out = out.filter(_OPS[op](F.col(field), _value(value)))
        else:
            raise ValueError(f"unknown operator {op!r}")
    return out.orderBy(*order).limit(limit) if limit else out
