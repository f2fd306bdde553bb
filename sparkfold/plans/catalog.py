"""All registered queries with their oracles."""

from __future__ import annotations

from . import aggregating, collections, computing, formats, further, joining, matching, merging, resolving, scalars, searching, streams, validating, windowing  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
