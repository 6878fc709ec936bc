"""Registered queries and whole requests."""

from millrace.plans import catalogue_queries, extraction_queries, routing_queries, store_queries, stream_queries, text_queries, vector_queries  # noqa: F401
from millrace.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
