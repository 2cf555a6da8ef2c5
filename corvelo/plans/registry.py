"""Registration of queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable


def registry() -> tuple[dict, Callable]:
    """(registered, decorator): `@query(sql)` registers a function (spark, folder) under its name."""
    registered: dict = {}

    def query(sql: str | None = None) -> Callable:
        def keep(function: Callable) -> Callable:
            registered[function.__name__] = (function, sql)
            return function

        return keep

    return registered, query
