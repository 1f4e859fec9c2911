"""Canonical domains: fields, constraints and unique keys (fixed values, data spec 1.2)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

SPEC_VERSION = "1.2"


@dataclass(frozen=True)
class Field:
    name: str
    kind: str  # timestamp, date, string, number
    constraint: str | None = None  # positive, non_negative, finite
    required: bool = True


@dataclass(frozen=True)
class Domain:
    name: str
    fields: tuple[Field, ...]
    key: tuple[str, ...]

    def struct(self) -> T.StructType:
        kinds = {"timestamp": T.TimestampType(), "date": T.DateType(), "string": T.StringType(), "number": T.DoubleType()}
        return T.StructType([T.StructField(f.name, kinds[f.kind]) for f in self.fields])


def _text(*names: str) -> tuple[Field, ...]:
    return tuple(Field(n, "string") for n in names)


def _numbers(constraint: str, *names: str) -> tuple[Field, ...]:
    return tuple(Field(n, "number", constraint) for n in names)


STATEMENT_METRICS = (
    "revenue", "net_income", "eps", "total_assets", "total_liabilities",
    "shareholder_equity", "operating_income", "free_cash_flow", "shares_outstanding",
)
_OHLCV = (*_numbers("positive", "open", "high", "low", "close"), *_numbers("non_negative", "volume"))

DOMAINS = {
    d.name: d
    for d in (
        Domain("equity_ohlcv", (Field("timestamp", "timestamp"), *_text("symbol"), *_OHLCV, *_text("source_vendor")),
               ("symbol", "timestamp", "source_vendor")),
        Domain("option_contract_reference",
               (*_text("option_symbol", "underlying_symbol"), Field("expiration_date", "date"), *_numbers("positive", "strike"),
                *_text("option_type"), *_numbers("positive", "multiplier"), *_text("source_vendor")),
               ("option_symbol", "source_vendor")),
        Domain("option_contract_ohlcv", (Field("timestamp", "timestamp"), *_text("option_symbol"), *_OHLCV, *_text("source_vendor")),
               ("option_symbol", "timestamp", "source_vendor")),
        Domain("option_open_interest",
               (Field("timestamp", "timestamp"), *_text("option_symbol"), *_numbers("non_negative", "open_interest"), *_text("source_vendor")),
               ("option_symbol", "timestamp", "source_vendor")),
        Domain("fundamentals",
               (*_text("symbol"), Field("report_date", "date"), *_text("fiscal_period"), *_numbers("finite", *STATEMENT_METRICS), *_text("source_vendor")),
               ("symbol", "report_date", "fiscal_period", "source_vendor")),
    )
}
