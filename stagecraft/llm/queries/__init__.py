"""Queries of the operators over the driver tables."""

from stagecraft.llm.queries import corpus, dialogue, licences, search, vectors  # noqa: F401  (each registers its queries)
from stagecraft.llm.queries.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
