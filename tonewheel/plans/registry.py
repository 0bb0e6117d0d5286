"""Where queries and their checking SQL are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tonewheel.sources.fixtures import duck_ctes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, views: tuple[str, ...] = (), sql: str | None = None, ctes: str = ""):
    """Registers a query; `sql` is its check in DuckDB over the named fixture views."""

    def register(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql is not None:
            items = [c for c in (duck_ctes(*views) if views else "", ctes) if c]
            recursive = "RECURSIVE " if "recursive" in ctes.lower() else ""
            ctes_text = ",\n".join(items).replace("/*recursive*/", "")
            ORACLES[name] = (f"WITH {recursive}{ctes_text}\n" if items else "") + sql
        return fn

    return register


def r6(col):
    from pyspark.sql import functions as F

    return F.round(col, 6)
