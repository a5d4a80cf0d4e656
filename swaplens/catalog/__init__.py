"""Registered queries: every operator over the given tables, next to equivalent SQL."""

from . import bar_queries, source_queries, study_queries, trade_queries  # noqa: F401
from .base import ORACLES, QUERIES  # noqa: F401
