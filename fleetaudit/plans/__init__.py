"""The audit: shared facts, checks by category, reports and the five profiles."""
from .facts import Facts
from .profiles import PROFILES, audit, findings_of
from . import reports

__all__ = ["PROFILES", "Facts", "audit", "findings_of", "reports"]
