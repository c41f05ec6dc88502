"""Every registered query."""

from catalograph.plans import fact_queries, graph_queries, read_queries, run_queries, source_queries, vector_queries  # noqa: F401
from catalograph.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
