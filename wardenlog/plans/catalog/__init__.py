"""Named queries with, where SQL can say the same, an equivalent statement for another engine."""

from . import alerts, cleaning, features, files, identity, incidents, models, reports, rules, streams, triage  # noqa: F401
from .registry import QUERIES, oracles

__all__ = ["QUERIES", "oracles"]
