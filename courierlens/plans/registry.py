"""The queries of the library and their SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from courierlens.plans.fixtures import FIXTURES, fx

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, *inputs: str, sql: str | None = None):
    """Register a function of DataFrames, one for each input, under a name, with its SQL over the same inputs."""

    def register(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: f(*(fx(spark, sf_dir, i) for i in inputs))
        if sql:
            ORACLE_SQL[name] = with_fixtures(sql)
        return f

    return register


def with_fixtures(sql: str) -> str:
    """The SQL with the fixtures that it names as common table expressions, and R6(x) as rounding like functions.arrays.round6."""
    sql = sql.replace("R6(", "ROUND(1.37e-9 + ")
    used = [f"{k} AS ({text})" for k, (_, text) in FIXTURES.items() if re.search(rf"\b{k}\b", sql)]
    if not used:
        return sql
    rest = sql.strip()
    m = re.match(r"WITH (RECURSIVE )?", rest)
    return f"WITH {(m and m[1]) or ''}{', '.join(used)}" + (f", {rest[m.end():]}" if m else f" {rest}")
