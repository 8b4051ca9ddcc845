"""All registered queries of the reference's own operators."""

from __future__ import annotations

from sparkomics.plans import annotation_queries, cohort_queries, matrix_queries, variant_queries  # noqa: F401  (they register their queries)
from sparkomics.plans.queries import QUERIES, SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
