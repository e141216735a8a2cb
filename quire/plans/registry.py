"""The query catalogue: every operator bound to the fixture views.

A catalogue entry is ``name -> (builder, oracle)`` where ``builder(views)``
returns a lazy DataFrame and ``oracle`` is DuckDB SQL over the same base
tables (``None`` when the operator has no SQL form). Column names match
between the two so results can be compared column by column.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from quire.plans.oracle_views import with_views
from quire.sources.views import Views


@dataclass(frozen=True)
class Entry:
    name: str
    build: Callable[[Views], DataFrame]
    oracle: str | None
    operator: str  # W id from the survey


CATALOG: dict[str, Entry] = {}


def register(name: str, w: str, oracle: str | None = None):
    def deco(fn: Callable[[Views], DataFrame]):
        if name in CATALOG:
            raise ValueError(f"duplicate query {name}")
        CATALOG[name] = Entry(name, fn, oracle, w)
        return fn
    return deco


def _load_all() -> None:
    # importing the binding modules fills CATALOG
    from quire.plans import cleaning, lists, joins, aggs, windows, funnel  # noqa: F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load_all()

    def bind(e: Entry):
        return lambda spark, sf_dir: e.build(Views(spark, sf_dir))

    return {k: bind(e) for k, e in CATALOG.items()}


def oracle_sql() -> dict[str, str]:
    _load_all()
    return {k: with_views(e.oracle) for k, e in CATALOG.items() if e.oracle}
