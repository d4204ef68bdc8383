"""All registered queries of the scoring engine and their SQL."""

from __future__ import annotations

from . import card_queries, source_queries  # noqa: F401  (they register their queries)
from .queries import Q as QUERIES
from .queries import S as ORACLES

__all__ = ["ORACLES", "QUERIES"]
