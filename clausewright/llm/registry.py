"""Queries and SQL of the operators for training-data pipelines."""

from __future__ import annotations

from clausewright.llm import ball_tree, bpe, chat, importance, language_id, lexical, line_dedup, mixing, near_dedup, spot_signatures, substring_dedup, token_counts, toxicity

MODULES = (substring_dedup, mixing, ball_tree, near_dedup, line_dedup, token_counts, toxicity, language_id, spot_signatures, bpe, lexical, chat, importance)
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
