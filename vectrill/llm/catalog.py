"""All queries of this package: importing this registers them."""

from vectrill.llm import queries  # noqa: F401
from vectrill.llm.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
