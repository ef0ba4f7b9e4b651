"""Lookups with fixed values: error codes, freshness, severities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# HTTP status to registry error code.
ERROR_CODES = {
    400: "VALIDATION_FAILED",
    401: "UNAUTHORIZED",
    403: "FORBIDDEN",
    404: "NOT_FOUND",
    409: "VERSION_EXISTS",
    410: "DEPRECATED",
    422: "VALIDATION_FAILED",
    429: "RATE_LIMITED",
    500: "INTERNAL_ERROR",
}
# How long a cached copy stays fresh, by status, in milliseconds.
FRESH_MS = {"verified": 3_600_000, "draft": 60_000, "review": 60_000}


def case_of(key: Column, table: dict, default: object = None) -> Column:
    """A literal lookup table as one CASE expression."""
    branches = None
    for match, value in table.items():
        test = key == match
        branches = F.when(test, F.lit(value)) if branches is None else branches.when(test, F.lit(value))
    return branches.otherwise(F.lit(default))


def error_code(http_status: Column) -> Column:
    return case_of(http_status, ERROR_CODES)


def freshness(status: Column, age_ms: Column) -> Column:
    """True while a cached copy may still be served; other statuses are stale at once."""
    return age_ms <= case_of(status, FRESH_MS, -1)
