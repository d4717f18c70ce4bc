"""Named queries over the driver tables."""

from recapflow.plans import memory_queries, session_queries, text_queries, whole_queries  # noqa: F401
from recapflow.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
