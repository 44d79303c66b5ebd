"""Registered queries: importing this package fills ``QUERIES`` and ``SQL``."""

from . import catalog, networks, runs, tables, texts
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "catalog", "networks", "runs", "tables", "texts"]
