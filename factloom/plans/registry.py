"""Registered queries: by name the plan over the driver's tables, and the SQL that it must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Plan = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Plan] = {}
ORACLE_SQL: dict[str, str] = {}


def add(name: str, plan: Plan, sql: str | None = None) -> None:
    if name in QUERIES:
        raise ValueError(f"{name} is registered twice")
    QUERIES[name] = plan
    if sql is not None:
        ORACLE_SQL[name] = sql


def query(sql: str | None = None):
    def register(f: Plan) -> Plan:
        add(f.__name__, f, sql)
        return f

    return register
