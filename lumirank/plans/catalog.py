"""All registered queries."""

from lumirank.plans import config_queries, lazy_queries, prep_queries, ranking_queries, source_queries, stage_queries  # noqa: F401
from lumirank.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
