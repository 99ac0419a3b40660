"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from . import chat, filter_audit, fingerprints, html_text, language, minhash, mixing, packing, simhash, source_divergence, token_counts, topk, toxicity

MODULES = (minhash, toxicity, language, html_text, packing, fingerprints, chat, mixing, token_counts, topk, filter_audit, simhash, source_divergence)
QUERIES = {name: query for m in MODULES for name, query in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in MODULES for name, sql in m.ORACLE_SQL.items()}
