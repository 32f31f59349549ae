"""Registered queries for the engine's own operators, with their oracles."""

from __future__ import annotations

import importlib

MODULES = ("retrieval_queries", "eval_queries", "catalog_queries", "window_queries", "calc_queries", "text_queries", "table_queries", "stream_queries", "visual_queries", "item_queries", "chat_queries", "period_queries", "spec_queries", "name_queries", "label_queries")

QUERIES: dict = {}
ORACLES: dict = {}
for _name in MODULES:
    _module = importlib.import_module(f"docloom.plans.{_name}")
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
