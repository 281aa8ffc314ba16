"""All queries of the reference's operators."""

from __future__ import annotations

from strandline.plans import catalog_queries, extract_queries, page_queries, source_queries, stream_queries, text_queries
from strandline.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "catalog_queries", "extract_queries", "page_queries", "source_queries", "stream_queries", "text_queries"]
