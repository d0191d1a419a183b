"""Queries over the fixture tables with an equivalent SQL text for checking."""

from tidemark.registry import (  # noqa: F401
    aggregates,
    corpus,
    ingest,
    models,
    recovery,
    reshaping,
    scalars,
    sequences,
    stations,
    tests,
)
from tidemark.registry.core import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
