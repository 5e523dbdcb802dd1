"""The registry of named queries over the driver's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def _modules() -> list:
    from . import affect, assembly, checks, corpora, dialogue, evaluation, events, extensions, files, machines, readers

    return [corpora, dialogue, evaluation, events, affect, assembly, extensions, readers, machines, files, checks]


def queries() -> dict[str, Query]:
    return {name: made for module in _modules() for name, made in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in _modules() for name, sql in module.SQL.items()}
