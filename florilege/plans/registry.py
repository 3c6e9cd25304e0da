"""Registers of queries and of their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    """The queries of one module by name, each with its oracle where SQL can say it."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracles: dict[str, str] = {}

    def query(self, oracle: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
        """Register a function under its name (or `name`)."""

        def add(f: Query) -> Query:
            self.queries[name or f.__name__] = f
            if oracle:
                self.oracles[name or f.__name__] = oracle
            return f

        return add
