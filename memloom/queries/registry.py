"""All queries of the core, by name, with the SQL that gives the same."""

from __future__ import annotations

from memloom.queries import extraction, graphs, hierarchies, learning, reconciling, retrieval, upkeep

_MODULES = (hierarchies, retrieval, graphs, extraction, reconciling, learning, upkeep)

QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
SQL = {k: q.strip() for m in _MODULES for k, q in m.SQL.items()}
FLAGSHIP = "retrieve_pack"
