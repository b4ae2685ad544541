"""Registry of named queries: a Spark plan builder and, where SQL can say the
same thing, an independent DuckDB oracle statement."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .oracle_base import with_prefix

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None, ctes: str = ""):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under ``name``.

    ``sql`` is the oracle body; it runs after the shared CTE prefix (and the
    optional extra ``ctes``). Without it the query gets a rows-only check.
    """

    def register(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = with_prefix(sql, ctes)
        return fn

    return register


def load_all() -> None:
    """Import every query module so its registrations run."""
    from . import (  # noqa: F401
        q_analysis,
        q_evidence,
        q_kpis,
        q_rankings,
        q_runs,
        q_sources,
        q_text,
    )
