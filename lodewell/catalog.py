"""Every query of the library by name, with the SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    """Decorator: puts a (spark, sf_dir) -> DataFrame callable in the catalogue, with its SQL if there is one."""

    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return keep
