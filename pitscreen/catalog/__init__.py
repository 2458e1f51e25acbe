"""Registered queries, grouped by area."""

from importlib import import_module

AREAS = ["inputs", "study", "chain", "grid", "series", "tables", "reports"]


def load():
    """(queries, sql) with every area imported."""
    for area in AREAS:
        import_module(f"pitscreen.catalog.{area}")
    from pitscreen.catalog.registry import QUERIES, SQL

    return QUERIES, SQL
