"""Queries by name, each with its SQL for comparison, and small tables of literal rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

_TYPES = {"string": "VARCHAR", "array<string>": "VARCHAR[]", "map<string,int>": "MAP(VARCHAR, INTEGER)"}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _written(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).upper()
    if isinstance(value, (list, tuple)):
        return "[" + ", ".join(map(_written, value)) + "]"
    if isinstance(value, str):
        return "'" + value.replace("'", "''") + "'"
    return repr(value)


class Rows:
    """A table of literal rows, the same for Spark and in SQL."""

    def __init__(self, schema: str, rows: list[tuple]):
        self.schema, self.rows = schema, rows

    def df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, self.schema)

    @property
    def sql(self) -> str:
        columns = [c.strip().split(" ", 1) for c in self.schema.split(", ")]
        body = ", ".join("(" + ", ".join(map(_written, r)) + ")" for r in self.rows)
        cast = ", ".join(f"CAST({c} AS {_TYPES.get(k, k.upper())}) AS {c}" for c, k in columns)
        return f"(SELECT {cast} FROM (VALUES {body}) AS _({', '.join(c for c, _ in columns)}))"
