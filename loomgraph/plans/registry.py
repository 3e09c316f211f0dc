"""All registered queries of the engine with their SQL."""

from __future__ import annotations

from . import more_queries  # noqa: F401, registers its own
from . import queries as _q


def queries() -> dict:
    return dict(_q.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_q.SQL)
