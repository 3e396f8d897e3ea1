"""Queries over the given tables: every operator on its own, then the audit profiles."""
from . import checks, operators, reports, sources, streams  # noqa: F401
from .registry import ORACLES, QUERIES, Tables

__all__ = ["ORACLES", "QUERIES", "Tables"]
