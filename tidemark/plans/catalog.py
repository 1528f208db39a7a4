"""All registered queries; importing the modules fills the registry."""

from __future__ import annotations

from tidemark.plans import exact_queries, metric_queries, model_queries, prepare_queries  # noqa: F401
from tidemark.plans.registry import QUERIES


def queries():
    return {name: q.run for name, q in QUERIES.items()}


def oracle_sql():
    return {name: q.sql for name, q in QUERIES.items() if q.sql is not None}
