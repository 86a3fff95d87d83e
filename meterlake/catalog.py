"""All registered queries of the library, with their DuckDB counterparts."""

from __future__ import annotations

import importlib

from meterlake import plans

for _name in ("usage", "logs", "rankings", "abuse", "health", "pricing", "flow", "models", "settlement", "texts", "streams"):
    importlib.import_module(f"meterlake.plans.{_name}")


def queries() -> dict:
    return dict(plans.QUERIES)


def oracle_sql() -> dict:
    return dict(plans.SQL)
