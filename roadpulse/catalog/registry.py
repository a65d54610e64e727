"""Registered queries and the SQL each is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from roadpulse.catalog.fixtures import Fixtures
from roadpulse.session import ship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: The functions themselves, to run them on other fixtures.
FUNCTIONS: dict[str, Callable[[Fixtures], DataFrame]] = {}


def query(name: str, check: str | None = None):
    """Registers a function of :class:`Fixtures` under ``name``."""

    def add(fn: Callable[[Fixtures], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return fn(Fixtures(spark, sf_dir))

        QUERIES[name], FUNCTIONS[name] = run, fn
        if check:
            ORACLES[name] = check
        return fn

    return add
