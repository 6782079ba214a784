"""Registered queries over the test tables, with the SQL that must give the same rows."""

from . import check_queries, mapping_queries, reconcile_queries, state_queries  # noqa: F401
from .registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
