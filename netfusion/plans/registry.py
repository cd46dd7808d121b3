"""All registered queries of the core library."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from netfusion.plans import composites, network, records, relational, scans

_MODULES = (relational, network, records, scans, composites)


def _all() -> dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]]:
    return {name: q for m in _MODULES for name, q in m.QUERIES.items()}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, (f, _) in _all().items()}


def oracle_sql() -> dict[str, str]:
    return {name: text for name, (_, text) in _all().items() if text}
