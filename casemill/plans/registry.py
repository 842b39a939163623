"""All registered queries over the driver's tables, and the SQL that each must equal."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    """Registers a function of (spark, sf_dir) under a name, with its SQL for DuckDB where SQL can say it."""

    def put(f: Callable) -> Callable:
        if name in QUERIES:
            raise ValueError(f"two queries are named {name}")
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


def load() -> None:
    """Imports the modules that register queries."""
    from casemill.plans import corpus_queries, dashboard_queries, kpi_queries, landing_queries, record_queries, report_queries, scalar_queries, streaming_queries  # noqa: F401
