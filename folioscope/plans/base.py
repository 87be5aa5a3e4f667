"""Registration of queries with their SQL, and literal tables that both engines read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_SQL_TYPES = {"string": "VARCHAR", "int": "INTEGER", "long": "BIGINT", "double": "DOUBLE", "boolean": "BOOLEAN", "array<string>": "VARCHAR[]", "array<int>": "INTEGER[]", "array<array<string>>": "VARCHAR[][]"}


def query(name: str, sql: str | None = None):
    """Register ``run(spark, sf_dir)`` under a name, with DuckDB SQL that gives the same rows."""

    def register(run):
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).upper()
    if isinstance(value, (list, tuple)):
        return "[" + ", ".join(map(_literal, value)) + "]"
    if isinstance(value, (int, float)):
        return repr(value)
    parts, out = str(value).split("\n"), []
    for part in parts:
        out.append("'" + part.replace("'", "''") + "'")
    return "(" + " || chr(10) || ".join(out) + ")" if len(out) > 1 else out[0]


class Rows:
    """A small literal table: the same rows for Spark and as SQL."""

    def __init__(self, ddl: str, rows: list[tuple]):
        self.ddl, self.rows = ddl, rows
        self.columns = [tuple(c.strip().split(" ", 1)) for c in ddl.split(", ")]

    def df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, self.ddl)

    @property
    def sql(self) -> str:
        """A parenthesised subquery."""
        names = ", ".join(n for n, _ in self.columns)
        casts = ", ".join(f"CAST({n} AS {_SQL_TYPES[t]}) AS {n}" for n, t in self.columns)
        values = ", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in self.rows)
        return f"(SELECT {casts} FROM (VALUES {values}) AS v({names}))"
