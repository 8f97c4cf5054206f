"""All queries of the library by name, and their SQL."""

from __future__ import annotations

from . import assembly_plans, context_plans, graph_plans, impact_plans, packet_plans, record_plans, scanner_plans, search_plans, span_plans, validation_plans

PLANS = (search_plans, graph_plans, record_plans, context_plans, span_plans, impact_plans, assembly_plans, scanner_plans, packet_plans, validation_plans)


def queries() -> dict:
    return {name: q for plan in PLANS for name, q in plan.queries().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for plan in PLANS for name, sql in plan.oracle_sql().items()}
