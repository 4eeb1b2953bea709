"""Registered queries over the given tables."""

import importlib
import importlib.util

MODULES = ("document_queries", "retrieval_queries", "graph_queries", "chat_queries", "ingest_queries")


def registered() -> tuple[dict, dict]:
    queries, oracles = {}, {}
    for name in MODULES:
        if importlib.util.find_spec(f"{__name__}.{name}"):
            m = importlib.import_module(f"{__name__}.{name}")
            queries |= m.Q
            oracles |= m.O
    return queries, oracles
