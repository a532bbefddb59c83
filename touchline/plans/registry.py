"""Registered queries and their DuckDB twins."""

from __future__ import annotations

from touchline.plans import crawl_queries, landed_queries, match_queries, model_queries, odds_queries, pricing_queries, report_queries
from touchline.plans.base import ORACLES, QUERIES

__all__ = ["FLAGSHIP", "ORACLES", "QUERIES", "crawl_queries", "landed_queries", "match_queries", "model_queries", "odds_queries", "pricing_queries", "report_queries"]
FLAGSHIP = "q_facts_latest"
