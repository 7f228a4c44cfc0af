"""All registered queries and their SQL twins."""

from __future__ import annotations

from tessera.plans import jobs, ranges, scores, services, tables, text, vectors  # noqa: F401  (they register their queries)
from tessera.plans.base import ORACLE_SQL, QUERIES

FLAGSHIP = "top_clips"

__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES"]
