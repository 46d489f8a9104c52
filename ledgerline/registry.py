"""The panel operators' queries and their DuckDB equivalents, by SURVEY id."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerline.plans.oracle import oracle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, select: str | None = None, *uses: str):
    """Register a query; select is its oracle over the named views of ledgerline.plans.oracle."""

    def put(f):
        QUERIES[name] = f
        if select is not None:
            ORACLES[name] = oracle(select, *uses) if uses else select
        return f

    return put
