"""The registered queries of the library and their SQL."""

from __future__ import annotations

from collections.abc import Callable

_QUERIES: dict[str, Callable] = {}
_SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Callable], Callable]:
    def keep(f: Callable) -> Callable:
        assert name not in _QUERIES, name
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return keep


def queries() -> dict[str, Callable]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
