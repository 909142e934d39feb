"""Gathers the query modules; importing them registers their queries."""

from statefold.plans import state_queries, storage_queries, stream_queries  # noqa: F401
from statefold.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
