"""Registered queries over the given tables, with the SQL that says the same."""

from linkscope.queries.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "load"]


def load() -> None:
    """Registers all queries."""
    from linkscope.queries import evidence, graph, models, second, sets, tables, words  # noqa: F401
