"""All queries: importing this registers them."""

from vectrill.plans import factory_queries, graph_queries, index_queries, more_queries, search_queries, table_queries  # noqa: F401
from vectrill.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
