"""Helper to put a query and its SQL side by side."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallyloom.plans.views import Views


class Register:
    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.oracles: dict[str, str] = {}
        self.builds: dict[str, Callable[[Views], DataFrame]] = {}

    def __call__(self, name: str, build: Callable[[Views], DataFrame], sql: str | None = None) -> None:
        self.builds[name] = build
        self.queries[name] = lambda spark, sf_dir: build(Views(spark, sf_dir))
        if sql is not None:
            self.oracles[name] = sql
