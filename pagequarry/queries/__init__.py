"""Registered queries with their DuckDB twins."""

from importlib import import_module

MODULES = ("listing_queries", "page_queries", "market_queries", "listing_summary_queries", "flow_queries", "summary_queries")


def all_queries() -> None:
    """Import every module that registers queries."""
    for module in MODULES:
        import_module(f"pagequarry.queries.{module}")
