"""All queries over the test tables, by name, with their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import answers, coverage, data, joins, keyed, reports, scores, text, transfer, vectors

#: Modules of this package; each has QUERIES (name: function of session and folder) and SQL (name: DuckDB text).
MODULES: list = [transfer, reports, data, vectors, text, scores, joins, answers, coverage, keyed]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.SQL.items()}
