"""All queries over the library's series operators, by identifier."""

from __future__ import annotations

from .queries import QUERIES, SQL, Query, aggregates, basic, changes, joins, streams, windows  # noqa: F401  (each adds its queries)


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
