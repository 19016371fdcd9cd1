"""Registered queries and their equivalents in SQL."""


def load() -> tuple[dict, dict]:
    """All queries, and the SQL of those that have it."""
    from tarn.plans import (  # noqa: F401
        aggregation, decision, extras, files, relational, scalar, statements, temporal, values,
    )
    from tarn.plans.registry import ORACLE, QUERIES

    return QUERIES, ORACLE
