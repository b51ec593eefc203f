"""Imports every module of queries, so that the registry is full."""

from __future__ import annotations

from . import audit_queries, finding_queries, ingest_queries, keyword_queries, run_queries, trend_queries
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "audit_queries", "finding_queries", "ingest_queries", "keyword_queries", "run_queries", "trend_queries"]
