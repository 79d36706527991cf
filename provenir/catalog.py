"""All queries of the library by name, and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function of (t), t being a reader of tables by name, as the query ``name``."""

    def register(f: Callable) -> Callable:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(lambda table: spark.read.parquet(f"{sf_dir}/{table}.parquet"))

        run.__doc__ = f.__doc__
        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return f

    return register


def load() -> None:
    """Import all modules that register queries."""
    from .plans import aggregates, dedup, drafting, evidence, findings, frameworks, grammar, indicator, joins, ledger, materialise, pages, phrases, register, retrieval, rules, shortlist, text, windows  # noqa: F401


load()
