"""The registered queries of the engine's own operators."""

from __future__ import annotations

from skyloom.plans import more_queries, sky_queries  # noqa: F401  (they register their queries)
from skyloom.plans.queries import QUERIES


def queries() -> dict:
    return {name: run for name, (run, _) in QUERIES.items()}


def oracle_sql() -> dict:
    return {name: statement for name, (_, statement) in QUERIES.items() if statement}
