"""Registered queries of the analytic operators, with the SQL that states the same result."""

from __future__ import annotations

from . import entity_queries, ledger_queries, order_queries, register_queries, registry_queries, rule_queries, text_queries, view_queries

MODULES = (order_queries, ledger_queries, entity_queries, text_queries, view_queries, rule_queries, registry_queries, register_queries)


def queries() -> dict:
    return {name: run for m in MODULES for name, (run, _) in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, (_, sql) in m.QUERIES.items() if sql}
