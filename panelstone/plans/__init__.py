"""Registered queries over the supplied tables, one module per theme."""

from panelstone.plans import appraisal_queries, history_queries, panel_queries, performance_queries, price_queries, score_queries, signal_queries, table_queries  # noqa: F401
