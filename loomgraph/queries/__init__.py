"""Every registered query of the graph engine, by family."""

from loomgraph.queries import activation, documents, ledgers, lookups, relations, sources, structure, texts  # noqa: F401
from loomgraph.queries.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
