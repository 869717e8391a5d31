"""Registered queries: every operator over the given tables."""

from finpanel.plans import book_queries, panel_queries, risk_queries, source_queries, stream_queries, table_queries  # noqa: F401
from finpanel.plans.catalog import ORACLES, QUERIES  # noqa: F401
