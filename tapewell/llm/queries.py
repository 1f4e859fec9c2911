"""The registered queries of this folder: each runs its operator over its whole table and derives the result columns."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
MODULES = ["q_decontaminate", "q_quality", "q_substring", "q_quotes", "q_sharding", "q_ann", "q_secrets", "q_jaccard", "q_bpe", "q_toxicity", "q_dac", "q_merkle", "q_periodic"]


def query(name: str, oracle: str | None = None):
    def register(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def load() -> None:
    for module in MODULES:
        importlib.import_module(f"tapewell.llm.{module}")
