"""All registered queries of the library."""

from __future__ import annotations

from . import content_queries, function_queries, match_queries, report_queries, stream_queries, structure_queries  # noqa: F401
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
