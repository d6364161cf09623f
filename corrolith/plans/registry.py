"""Where queries register themselves with the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corrolith.plans.bridge import with_sql

Query = Callable[[SparkSession, str], DataFrame]
ALL: dict[str, tuple[Query, str | None]] = {}


def query(sql: str | None, *shapes: str):
    """Registers a function under its name. sql follows the shapes that it reads; None where SQL can't express it."""

    def keep(f: Query) -> Query:
        if f.__name__ in ALL:
            raise ValueError(f"{f.__name__} is registered twice")
        ALL[f.__name__] = (f, f"{with_sql(*shapes)}{sql}" if shapes and sql else sql)
        return f

    return keep


def listed(values) -> str:
    """Values as an SQL list of strings."""
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"
