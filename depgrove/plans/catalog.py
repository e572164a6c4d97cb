"""The registered queries for the dependency-graph operators, each with its SQL."""

from __future__ import annotations

from . import graph_queries, join_queries, npm_queries, report_queries, scalar_queries, sink_queries, source_queries, triage_queries

MODULES = (graph_queries, scalar_queries, join_queries, report_queries, sink_queries, npm_queries, source_queries, triage_queries)


def queries() -> dict:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: text for module in MODULES for name, text in module.SQL.items()}
