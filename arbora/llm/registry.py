"""The registered queries of this subpackage and their DuckDB oracles."""

from __future__ import annotations

from arbora.llm import byte_bpe, chat, embedding_dedup, hard_negatives, jaccard, language, licenses, mixing, neighbours, quality, repeats, reversed_search, token_counts

MODULES = [byte_bpe, chat, token_counts, repeats, mixing, licenses, neighbours, quality, language, jaccard, hard_negatives, embedding_dedup, reversed_search]
QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ORACLES = {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
