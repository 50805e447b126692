"""Registered queries: name -> (Spark job, equivalent DuckDB SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Job = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Job] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Registers a job under its function name; `sql` is the query DuckDB answers on the same tables."""

    def register(job: Job) -> Job:
        key = name or job.__name__
        QUERIES[key] = job
        if sql is not None:
            ORACLES[key] = sql
        return job

    return register
