"""Imports every module of this subpackage that registers a query."""

from __future__ import annotations

from postroom.llm import conversations, decontaminate, language, licenses, packing, periods, quality, secrets, simhash, tokencounts, topk, vectorpacking, warc
from postroom.llm.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "conversations", "decontaminate", "language", "licenses", "packing", "periods", "quality", "secrets", "simhash", "tokencounts", "topk", "vectorpacking", "warc"]
