"""All queries of the engine and their SQL counterparts."""

from __future__ import annotations

from sentrylake.plans import analysis_queries, detection_queries  # noqa: F401 (they register their queries)
from sentrylake.plans.queries import QUERIES
from sentrylake.plans.queries import SQL as ORACLE_SQL

__all__ = ["ORACLE_SQL", "QUERIES"]
