"""Queries over the benchmark tables and their checking SQL."""
from importlib import import_module

_MODULES = ("text_queries", "line_queries", "geometry_queries", "job_queries", "plan_queries", "stream_queries")


def registered():
    """(queries, checking SQL) of all query modules."""
    from drawmark.checks.catalog import ORACLES, QUERIES
    for module in _MODULES:
        import_module(f"drawmark.checks.{module}")
    return QUERIES, ORACLES
