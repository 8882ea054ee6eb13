"""Registered queries: each binds one operator to the driver tables, beside its SQL check."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import Tables

BUILDERS: dict[str, Callable[[Tables], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Callable[[Tables], DataFrame]):
        if name in BUILDERS:
            raise ValueError(f"query {name} is registered twice")
        BUILDERS[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def runnable(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: BUILDERS[name](Tables(spark, sf_dir))
