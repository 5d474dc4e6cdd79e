"""All queries of the core: name -> plan builder, name -> SQL."""

from __future__ import annotations

from . import core_queries, drift_queries

_MODULES = (core_queries, drift_queries)
QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
SQL = {k: s for m in _MODULES for k, s in m.SQL.items()}
FLAGSHIP = "traj_message_stats"
