"""All registered queries and their SQL."""

from . import anchor_queries, annotation_queries, queries, report_queries, score_queries, source_queries, text_queries  # noqa: F401
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
