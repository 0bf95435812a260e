"""Queries of this subpackage, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

import importlib

MODULES = ("decontamination", "toxicity", "bpe", "html_text", "token_files", "quality", "near_dedup", "lattice_lm", "pii", "vector_dedup", "conversation_repair", "mixing", "resampling")


def collect() -> tuple[dict, dict]:
    queries, oracles = {}, {}
    for name in MODULES:
        m = importlib.import_module(f"quillspark.llm.{name}")
        queries |= m.QUERIES
        oracles |= m.ORACLES
    return queries, oracles
