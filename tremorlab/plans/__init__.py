"""Named queries and their reference SQL."""

from __future__ import annotations

from tremorlab.plans import feature_queries, governance_queries, metric_queries, model_queries, simulation_queries  # noqa: F401
from tremorlab.plans.registry import QUERIES, SQL


def queries() -> dict:
    """Every registered query."""
    return dict(QUERIES)


def oracle_sql() -> dict:
    """Reference SQL by query name."""
    return dict(SQL)
