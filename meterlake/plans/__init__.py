"""Registered queries: each operator applied to tables derived from the samples, with its DuckDB form."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function (spark, sf_dir) under its own name, with DuckDB SQL for the same rows."""

    def add(function):
        QUERIES[function.__name__] = function
        if sql:
            SQL[function.__name__] = sql
        return function

    return add


#: Moments of the sample events, which cover January 2024.
START, NOW = 1_704_067_200, 1_706_659_200
