"""All queries of the core and their SQL."""

from __future__ import annotations

from . import assembly_plans, coverage, detail_plans, file_plans, graph_plans, hot_nodes, overlap_plans, paf_plans, qubo_plans, score_plans, solution_plans

_MODULES = [hot_nodes, coverage, paf_plans, overlap_plans, score_plans, graph_plans, qubo_plans, file_plans, assembly_plans, solution_plans, detail_plans]

QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
SQL = {k: s for m in _MODULES for k, s in m.SQL.items()}
