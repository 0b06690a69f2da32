"""All registered queries and their DuckDB SQL."""

from __future__ import annotations

from . import analytics_queries, expert_queries, model_queries, selection_queries

FLAGSHIP = "flagship"
_MODULES = (model_queries, selection_queries, analytics_queries, expert_queries)
QUERIES: dict = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLES: dict = {k: v for m in _MODULES for k, v in m.ORACLES.items()}
