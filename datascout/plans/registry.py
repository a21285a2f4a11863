"""All catalog, discovery, profiling and search queries."""

from __future__ import annotations

from . import discovery, profiling, search

_GROUPS = (discovery, profiling, search)
QUERIES = {name: q for g in _GROUPS for name, q in g.QUERIES.items()}
SQL = {name: sql for g in _GROUPS for name, sql in g.SQL.items()}
