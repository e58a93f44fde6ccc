"""Registered queries of the search engine and their SQL."""

from __future__ import annotations

from . import configuration, diagnostics, documents, maintenance, search
from .registry import ORACLES, QUERIES

__all__ = ["FLAGSHIP", "configuration", "diagnostics", "documents", "maintenance", "oracle_sql", "queries", "search"]

FLAGSHIP = "search_ranked_topk"


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(ORACLES)
