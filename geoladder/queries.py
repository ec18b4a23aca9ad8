"""Registry of the layout engine's queries and their DuckDB equivalents."""

from __future__ import annotations

from geoladder.catalog import layout_queries, plan_queries

QUERIES: dict = {**layout_queries.QUERIES, **plan_queries.QUERIES}
ORACLE_SQL: dict[str, str] = {**layout_queries.ORACLE_SQL, **plan_queries.ORACLE_SQL}
