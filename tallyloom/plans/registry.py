"""Registered queries: a name, a function of (spark, sf_dir) and, where SQL can say it, the SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallyloom.model import TXN_SQL, transactions

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, txn: bool = True, recursive: bool = False) -> Callable[[Query], Query]:
    """Register a function under its name. txn: the SQL may use the transaction view."""

    def add(f: Query) -> Query:
        if f.__name__ in QUERIES:
            raise ValueError(f"{f.__name__} is registered already")
        QUERIES[f.__name__] = f
        if sql is not None:
            text = sql.strip()
            if txn:
                rest = text.removeprefix("WITH ")
                text = f"WITH {'RECURSIVE ' * recursive}{TXN_SQL}{', ' if rest != text else ' '}{rest}"
            ORACLE_SQL[f.__name__] = text
        return f

    return add


def worn(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """The rows of a SELECT over the transaction view (FROM txn), which a query's SQL uses as its input too."""
    return spark.sql(sql.replace("FROM txn", "FROM {txn}"), txn=transactions(spark, sf_dir))
