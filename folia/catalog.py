"""All registered queries outside the llm subpackage, with their oracles."""

from __future__ import annotations

from .plans import archive, drivers, relations, reports, sequences, streams, triage  # noqa: F401
from .plans.base import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
