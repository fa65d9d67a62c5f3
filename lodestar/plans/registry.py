"""Collects queries and their SQL by name."""

from __future__ import annotations

from collections.abc import Callable


class Registry:
    """queries: name to function of (spark, sf_dir); oracles: name to DuckDB SQL."""

    def __init__(self):
        self.queries: dict[str, Callable] = {}
        self.oracles: dict[str, str] = {}

    def query(self, sql: str | None = None):
        """Registers the decorated function under its name, with SQL if it has any."""

        def add(function: Callable) -> Callable:
            self.queries[function.__name__] = function
            if sql is not None:
                self.oracles[function.__name__] = sql
            return function

        return add
