"""All queries of the subpackage and their SQL."""

from __future__ import annotations

from . import link_queries, read_queries, text_queries

_MODULES = [read_queries, link_queries, text_queries]

QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
SQL = {k: s for m in _MODULES for k, s in m.SQL.items()}
