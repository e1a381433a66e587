"""Queries of the core operators, and the same in DuckDB SQL where SQL can express them."""

from valora.queries import lines, lookups, nested, runs, scores, texts

_MODULES = (texts, lines, scores, lookups, runs, nested)
QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}


def sql() -> dict[str, str]:
    return {k: v for m in _MODULES for k, v in m.sql().items()}
