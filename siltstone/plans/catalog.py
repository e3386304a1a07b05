"""All queries of the engine, without the llm subpackage's: name -> (query, oracle SQL or None)."""

from __future__ import annotations

from siltstone.plans import baseline_queries, code_queries, content_queries, history_queries, inventory_queries, review_queries

CATALOG = {**inventory_queries.QUERIES, **history_queries.QUERIES, **content_queries.QUERIES, **review_queries.QUERIES, **code_queries.QUERIES, **baseline_queries.QUERIES}
