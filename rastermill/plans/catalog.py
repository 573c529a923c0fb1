"""All registered queries over the driver's tables, with their SQL."""

from __future__ import annotations

from . import mask_queries, shape_queries, table_queries, window_queries

_ALL = mask_queries.QUERIES | window_queries.QUERIES | table_queries.QUERIES | shape_queries.QUERIES

QUERIES = {name: query for name, (query, _) in _ALL.items()}
ORACLE_SQL = {name: sql for name, (_, sql) in _ALL.items() if sql is not None}
