"""All queries of the subpackage and their SQL."""

from __future__ import annotations

from inkroll.llm import copies, frequent, garbled, lookalikes, mixing, packing, sentences, variants

_MODULES = (lookalikes, copies, frequent, garbled, variants, packing, mixing, sentences)


def queries() -> dict:
    return {name: query for module in _MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in _MODULES for name, sql in getattr(module, "SQL", {}).items()}
