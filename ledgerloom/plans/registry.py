"""All queries of the core with their SQL."""

from __future__ import annotations

from . import belief_queries, evidence_queries, gate_queries, graph_queries, hierarchy_queries, join_queries, kernel_queries, ledger_queries, overlay_queries, profile_queries, reference_queries, regime_queries, signal_queries, text_queries

MODULES = [reference_queries, hierarchy_queries, text_queries, graph_queries, evidence_queries, gate_queries, ledger_queries, regime_queries, overlay_queries, belief_queries, profile_queries, join_queries, signal_queries, kernel_queries]


def queries() -> dict:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: v for m in MODULES for k, v in m.ORACLE.items()}
