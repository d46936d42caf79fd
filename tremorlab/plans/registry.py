"""Registration of named queries with their reference SQL, and the common table expressions that the SQL shares."""

from __future__ import annotations

import re
from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}
CTES: dict[str, str] = {}
RECURSIVE: set[str] = set()


def cte(name: str, body: str, recursive: bool = False) -> None:
    """A named sub-query for reference SQL; it may use those defined before it."""
    CTES[name] = body
    if recursive:
        RECURSIVE.add(name)


def duck(final: str) -> str:
    """``final`` with the sub-queries it needs, in order."""
    need: set[str] = set()

    def visit(text: str) -> None:
        for name in CTES:
            if name not in need and re.search(rf"\b{name}\b", text):
                need.add(name)
                visit(CTES[name])

    visit(final)
    with_ = ",\n".join(f"{n} AS ({CTES[n]})" for n in CTES if n in need)
    recursive = "RECURSIVE " if any(n in RECURSIVE for n in need) else ""
    return f"WITH {recursive}{with_}\n{final}" if with_ else final


def query(sql: str | None = None) -> Callable:
    """Register a function (spark, sf_dir) under its name, with reference SQL where there is some."""

    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = duck(sql)
        return f

    return add


def r6(x: str) -> str:
    """SQL rounding to six digits without a negative zero."""
    return f"(round({x}, 6) + 0.0::DOUBLE)"
