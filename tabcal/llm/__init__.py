"""Corpus operators for training data: one module per operator, each with its registered query.

`load_queries()` returns {name: (query, SQL or None)}; nothing outside this package imports it.
"""

import importlib

MODULES = (
    "line_dedup", "license_scan", "source_mixing", "toxicity", "minhash_forest", "embedding_dedup", "sharding", "sentence_pieces",
    "chat_format", "merkle", "quality", "hard_negatives", "token_alignment",
)


def load_queries():
    found = {}
    for module in MODULES:
        found.update(importlib.import_module(f"tabcal.llm.{module}").QUERIES)
    pipeline = importlib.import_module("corpus_pipeline")
    found["pipeline"] = (pipeline.run, pipeline.ORACLE_SQL)
    return found
