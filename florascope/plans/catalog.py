"""The registry of queries: a Spark plan and, where SQL can express it, its DuckDB twin."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from florascope.sources import fixtures


class Views:
    """The driver's tables and the views over them, as attributes."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return fixtures.view(self.spark, self.sf_dir, name)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``plan(views) -> DataFrame`` under ``name``; ``sql`` may use every view by its name."""

    def register(plan: Callable[[Views], DataFrame]) -> Callable[[Views], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: plan(Views(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = with_views(sql)
        return plan

    return register


def with_views(sql: str) -> str:
    """``sql`` with the views it names put before it."""
    used = [v for v in fixtures.VIEWS if re.search(rf"\b{v}\b", sql)]
    head = fixtures.ctes(used)
    if not head:
        return sql
    body = sql.strip()
    if re.match(r"(?i)with\s", body):
        return f"WITH {head}, {body[5:]}"
    return f"WITH {head} {body}"
