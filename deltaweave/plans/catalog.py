"""Every registered query of the engine and the SQL it must agree with."""

from __future__ import annotations

from deltaweave.plans import benchmark_queries, incremental_queries, relational_queries  # noqa: F401  (they register themselves)
from deltaweave.plans.registry import ORACLE, QUERIES


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
