"""Named queries over a table directory, each with the SQL that must agree with it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    name: str
    run: Query
    oracle: str | None


_ENTRIES: dict[str, Entry] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def register(run: Query) -> Query:
        if name in _ENTRIES:
            raise ValueError(f"query {name} registered twice")
        _ENTRIES[name] = Entry(name, run, oracle)
        return run

    return register


def entries() -> dict[str, Entry]:
    from innings.plans import aggregates, audits, features, incremental, live, models, retrieval, stores, texts  # noqa: F401

    return dict(_ENTRIES)
