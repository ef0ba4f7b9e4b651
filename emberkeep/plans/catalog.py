"""All registered queries."""

from __future__ import annotations

from emberkeep.plans import (  # noqa: F401
    artefact_queries,
    checkpoint_queries,
    document_queries,
    linetext_queries,
    log_queries,
    scan_queries,
    stream_queries,
    vector_queries,
)
from emberkeep.plans.registry import ORACLE, QUERIES


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
