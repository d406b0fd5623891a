"""Registered queries: each pairs a Spark plan with the SQL that checks it."""

from queries.registry import all_oracles, all_queries

__all__ = ["all_queries", "all_oracles"]
