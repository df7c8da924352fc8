"""Registered queries: one callable and one SQL text for each key."""

from . import aggregates, functions, joins, keyed, lateness, rank, sources, transform, windows  # noqa: F401
from .base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
