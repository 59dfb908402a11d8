"""All registered queries."""

from __future__ import annotations

from checks import (  # noqa: F401
    q_aggregates,
    q_functions,
    q_jobs,
    q_joins,
    q_models,
    q_ranking,
    q_rules,
    q_scores,
    q_sources,
)
from checks.base import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
