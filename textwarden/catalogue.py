"""All core queries and their SQL by name."""

from __future__ import annotations

from .plans import curation, decisions, evidence, files, service, streams, surface, telemetry  # noqa: F401
from .plans.registry import QUERIES, SQL


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(SQL)
