"""All registered queries of the core."""

from __future__ import annotations

from skein.plans import extract_queries, graph_queries, more_queries, problems

_PARTS = (problems, graph_queries, more_queries, extract_queries)
QUERIES = {name: q for part in _PARTS for name, q in part.QUERIES.items()}
SQL = {name: q for part in _PARTS for name, q in part.SQL.items()}
