"""The queries of this package and their SQL."""

from __future__ import annotations

from importlib import import_module

MODULES = ("packing", "suffixdedup", "simhash", "toxicity", "topk", "decontaminate", "hmm", "language", "warc", "sharding", "embeddingdedup", "merkle", "lexical")

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
for _name in MODULES:
    _module = import_module(f"dendrospark.llm.{_name}")
    QUERIES |= _module.QUERIES
    ORACLE |= _module.ORACLE
