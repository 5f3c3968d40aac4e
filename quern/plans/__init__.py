"""Registered queries of the record engine, each with an independent DuckDB oracle where SQL can express it."""

from . import calls, collections, packages, records

QUERIES = records.QUERIES
ORACLE = records.ORACLE

__all__ = ["ORACLE", "QUERIES", "calls", "collections", "packages", "records"]
