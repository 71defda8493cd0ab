"""All registered queries."""

from noonward.plans import data_queries, run_queries, score_queries  # noqa: F401
from noonward.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
