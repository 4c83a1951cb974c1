"""All registered queries and the SQL of their expected results."""

from __future__ import annotations

from seqloom.plans import evaluation_queries, graph_queries, segment_queries, sequence_queries

_MODULES = (sequence_queries, segment_queries, graph_queries, evaluation_queries)

QUERIES = {name: fn for m in _MODULES for name, fn in m.QUERIES.items()}
SQL = {name: text for m in _MODULES for name, text in m.SQL.items()}
