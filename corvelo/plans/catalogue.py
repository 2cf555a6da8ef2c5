"""The registered queries of the engine's operators, with their SQL where SQL can express them."""

from __future__ import annotations

from corvelo.plans import counting, further, judging, matching, records, texts

_MODULES = (counting, records, texts, judging, matching, further)


def queries() -> dict:
    return {name: query for m in _modules() for name, (query, _) in m.REGISTERED.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _modules() for name, (_, sql) in m.REGISTERED.items() if sql}


def _modules():
    return _MODULES
