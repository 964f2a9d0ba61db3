"""The registry behind ``__spark_entry__``: query name → (Spark job, SQL twin).

A Spark job is ``fn(tables) -> DataFrame`` where ``tables`` is a
:class:`Tables` over one data directory. The SQL twin (or ``None`` for jobs
that SQL cannot express, such as streaming ones) reads the same driver
tables in DuckDB.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from duewatch.sources import fixtures
from duewatch.sources.fixtures import AS_OF
from duewatch.sources.runs import read_stored_runs


class Tables:
    """Lazily built inputs over one scale-factor directory.

    ``stored_runs`` points at a runs table written by
    :func:`duewatch.sources.runs.write_runs`; without it the runs view is
    derived from the driver tables on each use.
    """

    def __init__(self, spark: SparkSession, sf_dir: str, stored_runs: str | None = None):
        self.spark, self.sf_dir, self.stored_runs = spark, sf_dir, stored_runs
        self.as_of = AS_OF

    def table(self, name: str) -> DataFrame:
        return fixtures.table(self.spark, self.sf_dir, name)

    @cached_property
    def runs(self) -> DataFrame:
        if self.stored_runs:
            return read_stored_runs(self.spark, self.stored_runs)
        return fixtures.derive_runs(self.spark, self.sf_dir)

    @cached_property
    def commands(self) -> DataFrame:
        return fixtures.derive_commands(self.spark, self.sf_dir)

    @cached_property
    def http_requests(self) -> DataFrame:
        return fixtures.derive_http_requests(self.spark, self.sf_dir)

    @cached_property
    def delivery_attempts(self) -> DataFrame:
        return fixtures.derive_delivery_attempts(self.spark, self.sf_dir)

    @cached_property
    def create_requests(self) -> DataFrame:
        return fixtures.derive_create_requests(self.spark, self.sf_dir)

    @cached_property
    def complete_requests(self) -> DataFrame:
        return fixtures.derive_complete_requests(self.spark, self.sf_dir)


@dataclass(frozen=True)
class Query:
    name: str
    job: Callable[[Tables], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}


def register(name: str, sql: str | None):
    def deco(fn: Callable[[Tables], DataFrame]):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Query(name, fn, sql)
        return fn
    return deco


def load_all() -> dict[str, Query]:
    # Importing the modules fills REGISTRY.
    from duewatch.plans import (q_analytics, q_columns, q_filters, q_listing,  # noqa: F401
                                q_scans, q_metrics, q_lifecycle, q_misc)
    return REGISTRY
