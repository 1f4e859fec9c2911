"""Register of named queries with their SQL twins.

A query's ``spec`` lists its output columns as ``name:kind``; the same spec shapes the Spark result
and the SQL result, so both sides agree on names and types.  Kinds: s string, i bigint, b boolean,
t timestamp text, d date text, f double rounded to 6 places (f2, f8 ... for other places), o double cut to so many
places at a boundary where no short decimal lies (o4), for averages of prices, many of which would be rounding ties.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewell.sources.tables import Tables

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
CTES: dict[str, str] = {}
OFF = 0.318309886


def cte(name: str, sql: str) -> None:
    CTES[name] = sql.strip()


def _fields(spec: str) -> list[tuple[str, str]]:
    out = []
    for item in spec.split():
        name, _, kind = item.partition(":")
        out.append((name, kind or "s"))
    return out


def _shape(name: str, kind: str) -> Column:
    c = F.col(f"`{name}`")
    if kind == "s":
        c = c.cast("string")
    elif kind == "i":
        c = c.cast("bigint")
    elif kind == "b":
        c = c.cast("boolean")
    elif kind == "t":
        c = F.date_format(c.cast("timestamp"), "yyyy-MM-dd HH:mm:ss")
    elif kind == "d":
        c = F.date_format(c.cast("timestamp"), "yyyy-MM-dd")
    elif kind.startswith("o"):
        c = F.floor(c.cast("double") * 10.0 ** int(kind[1:]) + OFF) / 10.0 ** int(kind[1:])
    elif kind.startswith("f"):
        c = F.round(c.cast("double"), int(kind[1:] or 6)) + F.lit(0.0)
    else:
        raise ValueError(f"unknown kind {kind!r}")
    return c.alias(name)


def _shape_sql(name: str, kind: str) -> str:
    q = f'"{name}"'
    if kind == "s":
        e = f"CAST({q} AS VARCHAR)"
    elif kind == "i":
        e = f"CAST({q} AS BIGINT)"
    elif kind == "b":
        e = f"CAST({q} AS BOOLEAN)"
    elif kind == "t":
        e = f"strftime(CAST({q} AS TIMESTAMP), '%Y-%m-%d %H:%M:%S')"
    elif kind == "d":
        e = f"strftime(CAST({q} AS TIMESTAMP), '%Y-%m-%d')"
    elif kind.startswith("o"):
        e = f"floor(CAST({q} AS DOUBLE) * {10.0 ** int(kind[1:])} + {OFF}) / {10.0 ** int(kind[1:])}"
    else:
        e = f"round(CAST({q} AS DOUBLE), {int(kind[1:] or 6)}) + 0.0"
    return f"{e} AS {q}"


def _with(sql: str, found: dict[str, str] | None = None) -> dict[str, str]:
    """The named sub-queries a text uses, dependencies first."""
    found = {} if found is None else found
    for name, body in CTES.items():
        if name not in found and re.search(rf"\b{name}\b", sql):
            _with(body, found)
            found[name] = body
    return found


def oracle_text(spec: str, sql: str) -> str:
    parts = [f"{n} AS ({b})" for n, b in _with(sql).items()]
    parts.append(f"_result AS ({sql.strip()})")
    cols = ", ".join(_shape_sql(n, k) for n, k in _fields(spec))
    return f"WITH {', '.join(parts)} SELECT {cols} FROM _result"


def query(name: str, spec: str, sql: str | None = None) -> Callable[[Callable[[Tables], DataFrame]], Query]:
    """Register ``fn(tables) -> DataFrame`` under ``name``."""

    def register(fn: Callable[[Tables], DataFrame]) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return fn(Tables(spark, sf_dir)).select(*[_shape(n, k) for n, k in _fields(spec)])

        if name in QUERIES:
            raise ValueError(f"{name} registered twice")
        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = oracle_text(spec, sql)
        return run

    return register


def load() -> None:
    """Import every module that registers queries."""
    import importlib

    for module in MODULES:
        importlib.import_module(f"tapewell.plans.{module}")


MODULES = ["q_core", "q_data", "q_alt", "q_port", "q_exec", "q_stream"]
