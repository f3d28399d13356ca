"""All queries of the corpus operators."""

from __future__ import annotations

import importlib

from arborlift.llm.base import QUERIES, SQL

MODULES = ("native_queries", "token_queries", "dedup_queries", "scoring_queries", "private_queries", "text_queries", "fill_queries", "mining_queries", "join_queries")

for module in MODULES:
    importlib.import_module(f"arborlift.llm.{module}")

__all__ = ["QUERIES", "SQL"]
