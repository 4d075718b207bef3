"""Queries over the test tables and their SQL twins."""

from corvane.plans import catalog, hooks, lifecycle, pages, retrieval, tabular
from corvane.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "catalog", "hooks", "lifecycle", "pages", "retrieval", "tabular"]
