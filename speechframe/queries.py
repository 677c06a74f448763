"""All queries of the reference's operators, and their DuckDB SQL."""

from __future__ import annotations

from .plans import records, reports, speech, stored, streams, text, timeline, usage, vectors  # noqa: F401  they register themselves
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
