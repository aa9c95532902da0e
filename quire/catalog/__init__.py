"""The registered queries of the library and, where SQL can express them, their oracles for DuckDB."""

from quire.catalog import derived, markup, texts
from quire.catalog.register import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "derived", "markup", "texts"]
