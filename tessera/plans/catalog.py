"""All queries of the library by name, with SQL that computes the same rows."""

from __future__ import annotations

from collections.abc import Callable

from tessera.plans import acquisition_queries, page_queries, ranking_queries, source_queries, stream_queries, text_queries

MODULES = (text_queries, page_queries, ranking_queries, acquisition_queries, stream_queries, source_queries)
QUERIES: dict[str, Callable] = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ORACLE: dict[str, str] = {name: sql for m in MODULES for name, sql in m.ORACLE.items()}
