"""All queries of the library (without spandrel.llm), by name, and their SQL."""

from __future__ import annotations

from spandrel.plans import calendars, catalogs, outline_queries, party_queries, prose_queries, quote_queries, reference_queries, registers, retrieval, texts, tool_queries, type_queries  # noqa: F401  each adds its queries
from spandrel.plans.common import ORACLE_SQL, QUERIES

FLAGSHIP = "search_hybrid"
__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES"]
