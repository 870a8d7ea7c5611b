"""Queries over the driver's tables, one for each operator, with SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import models, relational, series, sets, tests

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    out: dict[str, Query] = {}
    for module in (series, tests, relational, models, sets):
        out |= module.QUERIES
    return out


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for module in (series, tests, relational, models, sets):
        out |= module.SQL
    return out
