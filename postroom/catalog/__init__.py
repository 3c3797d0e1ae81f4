"""Registered queries, each with the SQL that must give the same rows."""

from __future__ import annotations

from postroom.catalog import ingest, search, text, threads, transform
from postroom.catalog.registry import ORACLES, QUERIES  # noqa: F401

__all__ = ["QUERIES", "ORACLES", "ingest", "search", "text", "threads", "transform"]
