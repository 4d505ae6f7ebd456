"""All queries by name, with their SQL."""

from __future__ import annotations

from voxmeter.plans import comparisons, derived, evaluation, registry, relations, selection  # noqa: F401  importing registers their queries
from voxmeter.plans.registry import Query

FLAGSHIP = "q2_eval_summary"


def queries() -> dict[str, Query]:
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(registry.ORACLE)
