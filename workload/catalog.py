"""Registry of the queries: name, survey ids, Spark function, SQL twin."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    name: str
    ids: tuple[str, ...]
    run: Query
    sql: str | None


ENTRIES: dict[str, Entry] = {}


def query(name: str, ids: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its name with the inventory ids that it covers."""

    def wrap(fn: Query) -> Query:
        if name in ENTRIES:
            raise ValueError(f"{name} is registered twice")
        ENTRIES[name] = Entry(name, tuple(ids.split()), fn, sql)
        return fn

    return wrap
